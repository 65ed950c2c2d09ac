"""Statistics of each run, all from one pass over its sorted points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from .islands import ON_FOIL_KMH, with_islands
from .tracks import by_run

FOILING_HR_KMH = 15.0


def rollup(points: DataFrame, key: str = "run_id") -> DataFrame:
    """First tsi (and date and time of day, where points have them), largest and mean speed, duration and distance of each run."""
    return points.groupBy(key).agg(*_rollup(points))


def _rollup(points: DataFrame) -> list[Column]:
    return [*[F.min(c).alias(c) for c in ("date", "time") if c in points.columns], F.min("tsi").alias("ts"), F.max("speed").alias("max_speed_kmh"), F.avg("speed").alias("avg_speed_kmh"), (F.max("tsi") - F.min("tsi")).alias("duration_sec"), (F.max("distance") / 1000).alias("distance_km")]


def heart_rates(points: DataFrame, key: str = "run_id", limit: float = FOILING_HR_KMH) -> DataFrame:
    """Least and mean heart rate above a speed; a rate of 0 is missing."""
    hr = F.nullif(F.col("hr"), F.lit(0))
    return points.filter(F.col("speed") > limit).groupBy(key).agg(F.min(hr).alias("min_foiling_hr"), F.avg(hr).alias("avg_foiling_hr"))


def max_speed_1k(points: DataFrame, key: str = "run_id") -> DataFrame:
    return points.groupBy(key).agg(F.max("avg_speed_1k").alias("max_speed_1k"))


def foil_totals(points: DataFrame, key: str = "run_id", limit: float = ON_FOIL_KMH) -> DataFrame:
    """Time to the next row and way from the previous one, summed over rows above limit; null for a run without any."""
    w = by_run(key)
    stepped = points.withColumns({"__time": F.lead("tsi").over(w) - F.col("tsi"), "__way": F.col("distance") - F.lag("distance").over(w)})
    return stepped.groupBy(key).agg(*_totals(limit))


def _totals(limit: float) -> list[Column]:
    fast = F.col("speed") > limit
    return [F.sum(F.when(fast, F.col("__time"))).alias("duration_on_foil"), F.sum(F.when(fast, F.col("__way"))).alias("distance_on_foil")]


def furthest_from_land(points: DataFrame, key: str = "run_id") -> DataFrame:
    """Largest great-circle distance from a fix to its nearest point of land."""
    away = haversine_m(F.col("lat"), F.col("lon"), F.col("nearest_land_lat"), F.col("nearest_land_lon"))
    return points.groupBy(key).agg(F.max(away).alias("max_distance"))


def speed_and_heart(points: DataFrame, key: str = "run_id", limit: float = ON_FOIL_KMH) -> DataFrame:
    """Mean foiling speed, overall mean and largest heart rate."""
    hr = F.nullif(F.col("hr"), F.lit(0))
    return points.groupBy(key).agg(F.avg(F.when(F.col("speed") > limit, F.col("speed"))).alias("avg_foiling_speed"), F.avg(hr).alias("avg_hr"), F.max(hr).alias("max_hr"))


def run_stats(points: DataFrame, key: str = "run_id", limit: float = ON_FOIL_KMH, hr_limit: float = FOILING_HR_KMH, paddle_up_s: float = 15, first_s: float = 60) -> DataFrame:
    """All of the above, the islands, and the first and last fix, per run, in one pass; points have distance and avg_speed_1k.

    date and time are there where points have them; first_lat, first_lon, last_lat, last_lon and n_points where they have
    positions, for run_ends_of(); max_distance where they have their nearest land.

    Rows are first summed up by island (and by the stretches between), those sums by run: the windows and both
    aggregates share one hash partitioning on the run, and the points are read once.
    """
    w = by_run(key)
    hr = F.nullif(F.col("hr"), F.lit(0))
    stepped = with_islands(points, key, limit).withColumns({"__time": F.lead("tsi").over(w) - F.col("tsi"), "__way": F.col("distance") - F.lag("distance").over(w)})
    quick = F.col("speed") > hr_limit
    days = [c for c in ("date", "time") if c in points.columns]
    ends = {f"{n}_{c}": F.when(F.col(f"__{n}"), F.col(c)) for n in ("first", "last") for c in ("lat", "lon")} if {"lat", "lon"} <= set(points.columns) else {}
    if ends:
        stepped = stepped.withColumns({"__first": F.lag(F.lit(1)).over(w).isNull(), "__last": F.lead(F.lit(1)).over(w).isNull()})
    land = {"max_distance": haversine_m(F.col("lat"), F.col("lon"), F.col("nearest_land_lat"), F.col("nearest_land_lon"))} if {"nearest_land_lat", "nearest_land_lon"} <= set(points.columns) else {}
    ends |= land  # largest value of each, like the ends
    parts = stepped.groupBy(key, "island", "__fast").agg(
        F.min("tsi").alias("lo"), F.max("tsi").alias("hi"), F.min("distance").alias("from"), F.max("distance").alias("to"), F.max("speed").alias("top"), F.sum("speed").alias("sum"), F.count("speed").alias("n"),
        F.min(F.when(quick, hr)).alias("hr_min"), F.sum(F.when(quick, hr)).alias("hr_sum"), F.count(F.when(quick, hr)).alias("hr_n"), F.max("avg_speed_1k").alias("best"), F.count(F.lit(1)).alias("rows"), *[F.min(c).alias(c) for c in days], *[F.max(v).alias(n) for n, v in ends.items()], *_totals(limit))
    island, span, way = F.col("__fast"), F.col("hi") - F.col("lo"), F.col("to") - F.col("from")
    lasting = F.count_if(island & (span >= paddle_up_s))
    longest = F.max_by(F.when(island, F.struct(way.alias("way"), "lo", "hi")), F.when(island, F.struct(way.alias("way"), (-F.col("lo")).alias("early"))))
    out = parts.groupBy(key).agg(
        F.min("lo").alias("ts"), F.max("top").alias("max_speed_kmh"), F.try_divide(F.sum("sum"), F.sum("n")).alias("avg_speed_kmh"), (F.max("hi") - F.min("lo")).alias("duration_sec"), (F.max("to") / 1000).alias("distance_km"),
        F.min("hr_min").alias("min_foiling_hr"), F.try_divide(F.sum("hr_sum"), F.sum("hr_n")).alias("avg_foiling_hr"), F.max("best").alias("max_speed_1k"), F.sum("duration_on_foil").alias("duration_on_foil"), F.sum("distance_on_foil").alias("distance_on_foil"),
        *[F.min(c).alias(c) for c in days], *[F.max(n).alias(n) for n in ends], *([F.sum("rows").alias("n_points")] if len(ends) > len(land) else []), longest.alias("__l"), F.when(lasting > 0, lasting).alias("paddle_up_count"), F.min_by("from", F.when(island & (span >= first_s), F.col("lo"))).alias("distance_to_first_paddle_up"))
    named = {"longest_segment_distance": "way", "longest_segment_start": "lo", "longest_segment_end": "hi"}
    return out.withColumns({n: F.col(f"__l.{c}") for n, c in named.items()}).drop("__l")


def run_ends_of(stats: DataFrame, key: str = "run_id") -> DataFrame:
    """key, first and last (lat and lon) and n from run_stats(), as matching.run_ends() gives them from points."""
    return stats.select(key, *[F.struct(F.col(f"{n}_lat").alias("lat"), F.col(f"{n}_lon").alias("lon")).alias(n) for n in ("first", "last")], F.col("n_points").alias("n"))
