"""Islands: maximal stretches of rows above a speed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tracks import by_run

ON_FOIL_KMH = 11.0


def with_islands(points: DataFrame, key: str = "run_id", limit: float = ON_FOIL_KMH) -> DataFrame:
    """points plus __fast (speed above limit; a null speed is not) and island, the number of islands begun so far."""
    w = by_run(key)
    marked = points.withColumn("__fast", F.coalesce(F.col("speed") > limit, F.lit(False)))
    begun = marked.withColumn("__start", F.when(F.col("__fast") & ~F.coalesce(F.lag("__fast").over(w), F.lit(False)), 1).otherwise(0))
    return begun.withColumn("island", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def islands(points: DataFrame, key: str = "run_id", limit: float = ON_FOIL_KMH) -> DataFrame:
    """key, island, start_tsi, end_tsi, start_distance, distance, duration of each stretch of speed above limit; a null speed ends one."""
    rows = with_islands(points, key, limit).filter("__fast").groupBy(key, "island").agg(
        F.min("tsi").alias("start_tsi"), F.max("tsi").alias("end_tsi"), F.min("distance").alias("start_distance"), (F.max("distance") - F.min("distance")).alias("distance"))
    return rows.withColumn("duration", F.col("end_tsi") - F.col("start_tsi"))


def island_stats(found: DataFrame, key: str = "run_id", paddle_up_s: float = 15, first_s: float = 60) -> DataFrame:
    """Of each run: its longest island by distance (ties: the earlier), paddle-ups, and the distance at which the first long island starts; null where there is none."""
    longest = F.max_by(F.struct("distance", "start_tsi", "end_tsi"), F.struct("distance", -F.col("start_tsi")))
    lasting = F.count_if(F.col("duration") >= paddle_up_s)
    first = F.min_by("start_distance", F.when(F.col("duration") >= first_s, F.col("start_tsi")))
    out = found.groupBy(key).agg(longest.alias("__l"), F.when(lasting > 0, lasting).alias("paddle_up_count"), first.alias("distance_to_first_paddle_up"))
    return out.select(key, F.col("__l.distance").alias("longest_segment_distance"), F.col("__l.start_tsi").alias("longest_segment_start"), F.col("__l.end_tsi").alias("longest_segment_end"), "paddle_up_count", "distance_to_first_paddle_up")
