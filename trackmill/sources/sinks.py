"""Writers: partitioned, sorted exports and named CSV tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files that a task writes on average where partitions get several; the names of a thousand still sort.
FILES_A_TASK = 100


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows with those of equal keys in one partition, also when they are written.

    Keys are hashed first: Spark drops a repartition by the very keys of a join or sum before it, and may then read that
    exchange map by map, which scatters the keys. Files take time rather than bytes, so partitions are not put together.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def by_partition(rows: DataFrame, path: str, keys: list[str], order: str | None = None, gzip: bool = False, files: int = 1) -> None:
    """CSV folders by keys, only the partitions written being replaced; with files = 1 one (sorted) file each.

    With more, partitions too large for one task get several files: with an order, rows are dealt out by ranges of keys and order,
    and a task begins a new file when one is full, so large partitions are cut where their rows are many, and file names in order
    hold the rows in order; without, by keys and a hash of the row. files is the mean number over all partitions, which are
    counted. Tasks are many files each, so their number does not grow as that of the partitions does.
    """
    full = None
    if files > 1 and order:
        found, n = rows.groupBy(*keys).count().agg(F.count(F.lit(1)), F.sum("count")).first()
        due = files * max(1, found)
        full = math.ceil((n or 1) / due)
        shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = rows.repartitionByRange(min(due, max(shuffled, math.ceil(due / FILES_A_TASK))), *keys, order)
    else:
        spread = [F.pmod(F.xxhash64(*rows.columns), F.lit(files))] if files > 1 else []
        out = dealt(rows, *keys, *spread)
    if order:
        out = out.sortWithinPartitions(*keys, order)
    writer = out.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
    writer = writer.option("maxRecordsPerFile", full) if full else writer
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def table(rows: DataFrame, path: str) -> None:
    """A CSV table with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def buoy_rows(rows: DataFrame, path: str) -> None:
    """Buoy rows of any number of files as one table, times as `2025-01-02 03:26:00Z`."""
    table(rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss'Z'").alias("ts"), "wave_height", "wave_period", "wave_direction", "water_temp"), path)


def cleaned_tracks(rows: DataFrame, path: str, key: str = "run_id") -> None:
    """The rows of track_rows(), one folder per track, in order."""
    by_partition(rows, path, [key], "idx")
