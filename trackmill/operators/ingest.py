"""Import and publication of runs, end to end, as transforms of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import by_partition
from .dashboard import recent_points
from .kept import keep
from .matching import attach_runs, file_starts, match_files, new_files, require_matched, with_beaches
from .merge import write_back
from .nearest import distance_to_land, nearest_land
from .runstats import run_stats
from .tracks import with_distance, with_trailing_means


def import_points(staged: DataFrame, runs: DataFrame, known: DataFrame, coast: DataFrame) -> DataFrame:
    """Points (run_id and derived columns) of the staged files that are new; raises if one matches no run.

    Fixes of one file at one tsi are ordered by seq; where staged has none, by a hash of their values, which a repeated
    read gives again (a row number made while reading would not be the same after a retry).
    """
    fresh = new_files(staged, runs, known)
    rows = fresh.withColumn("seq", F.xxhash64("tsi", "lat", "lon")) if "seq" not in fresh.columns else fresh
    # One row for each file: written once, so that the check and the join do not read all points for it again.
    starts = keep(file_starts(rows), "file-starts")
    matches = match_files(starts, runs)
    require_matched(starts, matches)
    measured = with_trailing_means(with_distance(rows.drop("distance", "avg_speed_15s", "avg_speed_1k"), "filename"), "filename")
    return nearest_land(attach_runs(measured, matches).withColumnRenamed("id", "run_id"), coast)


def update_runs(runs: DataFrame, points: DataFrame, beaches: DataFrame) -> DataFrame:
    """runs (id) with all statistics of points (run_id), each written back in its own mode, from one pass over the points and one join."""
    stats = run_stats(points)
    ends = stats.withColumns({n: F.struct(F.col(f"{n}_lat").alias("lat"), F.col(f"{n}_lon").alias("lon")) for n in ("first", "last")}).withColumn("n", F.col("n_points"))
    days = [c for c in ("date", "time") if c in stats.columns]
    groups = [
        ("overwrite", ["ts", *days, "max_speed_kmh", "avg_speed_kmh", "duration_sec", "distance_km", "longest_segment_distance", "longest_segment_start", "longest_segment_end"]),
        ("all", ["duration_on_foil", "distance_on_foil"]), ("present", ["paddle_up_count"]), ("present", ["distance_to_first_paddle_up"]),
        ("fill", ["min_foiling_hr", "avg_foiling_hr"]), ("fill", ["max_speed_1k"]), ("fill", ["max_distance"]), ("fill", ["start_pos", "end_pos"])]
    return write_back(runs, with_beaches(ends, beaches).withColumnRenamed("run_id", "id"), "id", groups)


def publish_points(points: DataFrame, runs: DataFrame, path: str, days: int = 14, as_of: Column | None = None, key: str = "run_id") -> None:
    """Points (with the nearest land) of recent runs with distance_to_land, one folder and one sorted, gzipped file for each run."""
    by_partition(distance_to_land(recent_points(points, runs, days, key, as_of)), path, [key], "tsi", gzip=True)
