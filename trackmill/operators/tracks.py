"""Running distance, trailing means and relative time of tracks.

A track is the rows of one run, ordered by tsi (epoch seconds) and seq. All functions keep one hash partitioning
on run_id: a run is bounded (hours at about one fix a second), whatever the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.geo import haversine_m


def by_run(key: str = "run_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy("tsi", "seq")


def micros(seconds: Column) -> Column:
    """Epoch seconds as whole microseconds, rounded half to even."""
    return F.rint(seconds * 1_000_000).cast("long")


def with_distance(points: DataFrame, key: str = "run_id", lat: str = "lat", lon: str = "lon", order: WindowSpec | None = None) -> DataFrame:
    """points plus step_m (metres from the previous fix, 0 for the first) and distance (running metres)."""
    w = order or by_run(key)
    step = F.coalesce(haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)), F.lit(0.0))
    return points.withColumn("step_m", step).withColumn("distance", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def with_trailing_means(points: DataFrame, key: str = "run_id", seconds: float = 15, metres: float = 1000) -> DataFrame:
    """points (with distance) plus avg_speed_15s and avg_speed_1k: means of speed over the last seconds and metres, both ends and peers included."""
    by_time = Window.partitionBy(key).orderBy("__us").rangeBetween(int(-seconds * 1_000_000), 0)
    by_way = Window.partitionBy(key).orderBy("distance").rangeBetween(-metres, 0)
    return points.withColumn("__us", micros(F.col("tsi"))).withColumns({"avg_speed_15s": F.avg("speed").over(by_time), "avg_speed_1k": F.avg("speed").over(by_way)}).drop("__us")


def relative(series: DataFrame, key: str, at: str = "tsi", into: str = "t") -> DataFrame:
    """series plus the time since its first row."""
    return series.withColumn(into, F.col(at) - F.min(at).over(Window.partitionBy(key)))


def progress(points: DataFrame, key: str = "run_id") -> DataFrame:
    """points (with distance) plus elapsed seconds and the share of the run's distance so far."""
    whole = F.max("distance").over(Window.partitionBy(key))
    return relative(points, key, into="elapsed").withColumn("done", F.try_divide(F.col("distance"), whole))


def split_on_foil(points: DataFrame, limit: float = 11) -> DataFrame:
    """points plus speed_on and speed_off: speed where above the limit, or not; the other is null."""
    on = F.coalesce(F.col("speed") > limit, F.lit(False))
    return points.withColumns({"speed_on": F.when(on, F.col("speed")), "speed_off": F.when(~on, F.col("speed"))})
