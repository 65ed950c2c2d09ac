"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Characters handled at once by the vectorised text helpers; a longer text is a chunk of its own.
CHUNK_CHARS = 250_000
#: Bytes of text that a task turns into Python objects at once; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000

#: Rows that a kept table's writer holds back before they go to disk.
ROW_GROUP_BYTES = 16 << 20

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="trackmill-"))
    return _own_folder[0]


def keep(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes kept tables that nothing reads any more: whatever was made of them has been written."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def trim() -> None:
    """Gives memory that Python has done with back to the system: idle workers live on beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about limit bytes of column at most, whatever the number of rows that came at once."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    trim()


def chunked(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) over texts so that each stretch has about limit characters at most."""
    at, used = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > at and used + n > limit:
            yield at, i
            at, used = i, 0
        used += n
    if at < len(texts):
        yield at, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add (compared without case, as Spark does)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])
