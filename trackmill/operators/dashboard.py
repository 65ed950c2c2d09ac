"""Summaries of the run table."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import foil_name

DRY_LIMIT = 0.97


def enrich(runs: DataFrame, dry_limit: float = DRY_LIMIT) -> DataFrame:
    """runs plus started (timestamp), foil name, shares on foil by way and time, month, week (from Sunday), dry, and wind_data where wind columns are there."""
    started = F.timestamp_seconds(F.col("ts"))
    day = F.to_date(started)
    out = runs.withColumns({
        "started": started, "foil": foil_name(F.col("foil")) if "foil" in runs.columns else F.lit("unknown foil"),
        "pct_dist_on_foil": F.try_divide(F.col("distance_on_foil"), F.col("distance_km") * 1000), "pct_time_on_foil": F.try_divide(F.col("duration_on_foil"), F.col("duration_sec")),
        "month": F.trunc(day, "month"), "week": F.date_sub(day, F.dayofweek(day) - 1),
        "dry": F.coalesce(F.try_divide(F.col("longest_segment_distance"), F.col("distance_on_foil")) > dry_limit, F.lit(False))})
    names = {"avg_avg": "avg_wavg", "avg_max": "max_wavg", "gust_avg": "avg_wgust", "gust_max": "max_wgust", "avg_dir": "avg_wdir"}
    if all(c in runs.columns for c in names.values()):
        out = out.withColumn("wind_data", F.struct(*[F.col(c).alias(n) for n, c in names.items()]))
    return out


def recent(rows: DataFrame, days: int, at: str = "ts", as_of: Column | None = None) -> DataFrame:
    """Rows whose epoch seconds are less than days before as_of (now)."""
    now = F.unix_timestamp(as_of if as_of is not None else F.current_timestamp())
    return rows.filter(F.col(at) > now - days * 86_400)


def dry_runs(runs: DataFrame) -> DataFrame:
    """Dry runs, newest first."""
    return runs.filter("dry").orderBy(F.desc("ts"))


def newest_first(runs: DataFrame, key: str = "run_id") -> DataFrame:
    return runs.orderBy(F.desc("ts"), key)


def latest(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """The latest run."""
    return newest_first(runs, key).limit(1)


def totals(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """One row: count, sums, maxima and the run at each maximum (ties: the earlier)."""
    best = lambda c: F.max_by(key, F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("ts")))).alias(f"{c}_run")
    tops = ("max_speed_kmh", "max_speed_1k", "longest_segment_distance", "max_distance")
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), *[F.sum(c).alias(f"sum_{c}") for c in ("duration_sec", "distance_km", "paddle_up_count")], *[x for c in tops if c in runs.columns for x in (F.max(c).alias(c), best(c))])


def outings(runs: DataFrame) -> DataFrame:
    """Count and duration of each month and region, with the month's own totals."""
    rows = runs.groupBy("month", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("duration_sec"))
    whole = Window.partitionBy("month")
    return rows.withColumns({"month_n": F.sum("n").over(whole), "month_duration_sec": F.sum("duration_sec").over(whole)})


def weekly_band(runs: DataFrame, column: str = "max_speed_1k", key: str = "run_id") -> DataFrame:
    """Least and largest value of each week, its runs and the beaches of its first run."""
    first = F.min_by(F.struct("start_beach", "end_beach"), F.struct("ts", key))
    return runs.groupBy("week").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("n"), first.alias("b")).select("week", "low", "high", "n", "b.start_beach", "b.end_beach")


def weekly_heart_rates(runs: DataFrame) -> DataFrame:
    """Bands of least and mean foiling heart rate of each week, of runs with a valid least rate."""
    rows = runs.filter("min_foiling_hr > 0")
    return rows.groupBy("week").agg(*[f(c).alias(f"{n}_{c}") for c in ("min_foiling_hr", "avg_foiling_hr") for n, f in (("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("n"))


#: The groups of overview(), each by its columns.
OVERVIEW = {"all": (), "month": ("month",), "region of month": ("month", "region"), "week": ("week",), "launch": ("start_beach",), "landing": ("end_beach",), "way": ("start_beach", "end_beach")}


def overview(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """What totals(), outings(), weekly_band(), beach_totals() and launches() count, from one pass over the runs: a row for each group of each kind of OVERVIEW.

    kind, the columns of its group (others are null), n, sums of duration, distance and paddle-ups, the least and largest
    speed over 1 km, and the first run with its beaches.
    """
    columns = list(dict.fromkeys(c for by in OVERVIEW.values() for c in by))
    # The bits of a grouping id stand for the columns that a group leaves out, the first column's highest.
    number = lambda by: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in by)
    kind = functools.reduce(lambda out, k: F.when(F.col("__set") == number(OVERVIEW[k]), k).otherwise(out), OVERVIEW, F.lit(None).cast("string"))
    first = F.min_by(F.struct(F.col(key).alias("run"), F.col("start_beach").alias("from"), F.col("end_beach").alias("to")), F.struct("ts", key))
    rows = runs.groupingSets([[F.col(c) for c in by] for by in OVERVIEW.values()], *columns).agg(
        F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in ("duration_sec", "distance_km", "paddle_up_count")],
        F.min("max_speed_1k").alias("low_speed_1k"), F.max("max_speed_1k").alias("high_speed_1k"), first.alias("__first"))
    return rows.withColumns({"kind": kind, "first_run": F.col("__first.run"), "first_from": F.col("__first.from"), "first_to": F.col("__first.to")}).drop("__set", "__first")


def launches(runs: DataFrame) -> DataFrame:
    """Runs from each beach to each beach."""
    return runs.groupBy("start_beach", "end_beach").agg(F.count(F.lit(1)).alias("n"))


def beach_totals(runs: DataFrame) -> DataFrame:
    """Launches and landings of each beach that runs start or end at; most launches first, then by name."""
    ends = runs.select(F.explode(F.array(F.struct(F.col("start_beach").alias("beach"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("end_beach").alias("beach"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("e"))
    return ends.groupBy("e.beach").agg(F.sum("e.a").alias("launches"), F.sum("e.b").alias("landings")).orderBy(F.desc("launches"), "beach")


def landing_matrix(runs: DataFrame, names: list[str]) -> DataFrame:
    """One row per start beach, one column per end beach of names."""
    return runs.groupBy("start_beach").pivot("end_beach", names).count().na.fill(0)


def beach_names(runs: DataFrame) -> DataFrame:
    """Distinct start and end beaches in order."""
    return runs.select(F.explode(F.array("start_beach", "end_beach")).alias("beach")).distinct().orderBy("beach")


def recent_points(points: DataFrame, runs: DataFrame, days: int = 14, key: str = "run_id", as_of: Column | None = None) -> DataFrame:
    """Points of recent runs."""
    return points.join(recent(runs, days, as_of=as_of).select(key), key, "left_semi")
