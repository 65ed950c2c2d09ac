"""Drop-folder ingest: files that appear in a folder are read once, handed to an import, and archived.

A batch may be run again after a failure, with the same number and the same files. So what a batch makes is written
under its number, in place of what an earlier attempt left there, and made from what batches of smaller numbers wrote:
running it again gives the same tables, whether the first attempt failed before, while or after writing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import import_points
from ..operators.merge import LIST_COLUMNS, upsert
from ..sources.readers import LIST_SCHEMA, POINT_SCHEMA, listed_by_few, normalise_list, normalise_points


def point_stream(spark: SparkSession, folder: str, archive: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Normalised points of files as they appear; read files move to archive, if one is named."""
    reader = spark.readStream.schema(POINT_SCHEMA).option("header", True).option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return normalise_points(reader.csv(folder).withColumn("__path", F.col("_metadata.file_path")))


def ingest(points: DataFrame, checkpoint: str, load: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs load(batch, number) on what has come since the last call, then ends; checkpoint remembers."""
    return points.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_all(points: DataFrame, checkpoint: str, load: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """ingest() to its end; a batch's files are listed by a task for each core instead of one for each file."""
    with listed_by_few(points.sparkSession):
        query = ingest(points, checkpoint, load)
        query.awaitTermination()
    return query


def list_stream(spark: SparkSession, folder: str, archive: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Entries of run lists as they appear."""
    reader = spark.readStream.schema(LIST_SCHEMA).option("header", True).option("escape", '"').option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return normalise_list(reader.csv(folder))


class Store:
    """Tables of batches in a folder: runs (each batch a whole new version) and points (each batch those of its files)."""

    def __init__(self, spark: SparkSession, path: str, runs_schema: str):
        self.spark, self.path, self.runs_schema = spark, path.rstrip("/"), runs_schema

    def _numbers(self, name: str, below: int | None) -> list[int]:
        """Batches that were written to the end, of numbers below one."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = top.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = [int(f.getPath().getName().split("=")[1]) for f in (files.listStatus(top) if files.exists(top) else []) if files.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return sorted(n for n in found if below is None or n < below)

    def write(self, name: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def runs(self, below: int | None = None) -> DataFrame:
        """The newest version of the run table, or that before batch number below."""
        numbers = self._numbers("runs", below)
        if not numbers:
            return self.spark.createDataFrame([], self.runs_schema)
        return self.spark.read.schema(self.runs_schema).parquet(f"{self.path}/runs/batch={numbers[-1]}")

    def points(self, below: int | None = None) -> DataFrame | None:
        """The points of all batches, or of those before number below."""
        numbers = self._numbers("points", below)
        return self.spark.read.parquet(*[f"{self.path}/points/batch={n}" for n in numbers]) if numbers else None


RUNS = "id string, filename string, sport string, ts double, date date, time string, max_speed_kmh double, avg_speed_kmh double, duration_sec double, distance_km double, feeling long, board string, foil string"


def import_drop(spark: SparkSession, lists: str, points: str, store: Store, coast: DataFrame, archive: str | None = None, after: Callable[[str, int], None] | None = None) -> None:
    """Takes in what lies in two folders: run lists first, then point files; read files go to the archive once their batch is done.

    Later lists update runs of the same file name; files whose run has points already are left out; a file that matches
    no run stops the import, as import_points() does. after(table, number) is called when a batch has been written.
    Point files are staged first, then all that is staged and not yet imported is one batch.
    """
    done = after or (lambda table, number: None)

    def take_list(batch: DataFrame, number: int) -> None:
        # Of entries of one name in a batch the newest counts.
        new = batch.groupBy("filename").agg(F.max_by(F.struct(*LIST_COLUMNS), F.struct("ts", F.xxhash64(*LIST_COLUMNS))).alias("e")).select("filename", "e.*")
        store.write("runs", number, upsert(store.runs(below=number), new))
        done("runs", number)

    def take_points(batch: DataFrame, number: int) -> None:
        known = store.points(below=number)
        known = known.select("run_id") if known is not None else spark.createDataFrame([], "run_id string")
        store.write("points", number, import_points(batch, store.runs(), known, coast))
        done("points", number)

    ingest_all(list_stream(spark, lists, archive and f"{archive}/lists"), f"{store.path}/state/lists", take_list)
    # Files are taken in by small batches, but measured together: a batch's work includes the whole coast.
    staged, files = f"{store.path}/staged", point_stream(spark, points, archive and f"{archive}/points")
    with listed_by_few(spark):
        files.writeStream.format("parquet").option("path", staged).option("checkpointLocation", f"{store.path}/state/files").trigger(availableNow=True).start().awaitTermination()
    ingest_all(spark.readStream.schema(files.schema).parquet(staged), f"{store.path}/state/points", take_points)
