"""Files that the round-trip queries write and read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import listed_by_few
from ..sources.sinks import dealt


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared one; where it names none, a temporary one on a single machine, and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="trackmill-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def named_files(rows: DataFrame, path: str, key: str, order: list[str], name: str, lines: bool = False) -> str:
    """One sorted file for each value of key, called by name with `{}` for it: as people drop them. lines: a single column of text, else CSV with a header."""
    spark = rows.sparkSession
    written = dealt(rows, key).sortWithinPartitions(key, *order)
    writer = written.drop(*[o for o in order if o.startswith("__")]).write.partitionBy(key)
    writer.text(f"{path}-parts") if lines else writer.option("header", True).csv(f"{path}-parts")
    place = spark._jvm.org.apache.hadoop.fs.Path  # looked up once: each part of the name is a call to the JVM
    target = place(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(target)
    # Spark lists the files: asking the file system from here for each folder's would take most of the time where they are many.
    with listed_by_few(spark):
        found = [unquote(f) for f in spark.read.text(f"{path}-parts").inputFiles()]
    for part in found:
        value = part.rsplit("/", 2)[1].split("=", 1)[1]
        if not files.rename(place(part), place(target, name.format(value))):
            raise OSError(f"{part} could not be renamed")
    return path
