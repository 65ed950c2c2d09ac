"""Crashes: sudden stops in the middle of a run, and their density on a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import hex_cell, mercator
from .tracks import by_run, micros


def crashes(points: DataFrame, key: str = "run_id", mean_over: float = 15, now_below: float = 5, before: float = 5, window_s: float = 15, margin_s: float = 300) -> DataFrame:
    """Rows whose trailing mean speed is high while they are slow and the row before was not, strictly inside the margins of the run; avg_speed is that mean."""
    by_time = Window.partitionBy(key).orderBy("__us").rangeBetween(int(-window_s * 1_000_000), 0)
    whole = Window.partitionBy(key)
    seen = points.withColumn("__us", micros(F.col("tsi"))).withColumns({
        "avg_speed": F.avg("speed").over(by_time), "__prev": F.lag("speed").over(by_run(key)), "__lo": F.min("tsi").over(whole), "__hi": F.max("tsi").over(whole)})
    hit = (F.col("avg_speed") > mean_over) & (F.col("speed") < now_below) & (F.coalesce("__prev", F.lit(0.0)) >= before)
    return seen.filter(hit & (F.col("tsi") > F.col("__lo") + margin_s) & (F.col("tsi") < F.col("__hi") - margin_s)).drop("__us", "__prev", "__lo", "__hi")


def density(found: DataFrame, scale: float, left: float, top: float, width: float, height: float, radius: float = 20) -> DataFrame:
    """q, r, n, max_n: crashes in each hexagon of a Mercator map; scale: pixels a radian, left and top: radians of its corner; points outside are left out."""
    x, y = mercator(F.col("lat"), F.col("lon"))
    seen = found.withColumns({"__x": (x - left) * scale, "__y": (y - top) * scale}).filter((F.col("__x") >= 0) & (F.col("__x") <= width) & (F.col("__y") >= 0) & (F.col("__y") <= height))
    q, r = hex_cell(F.col("__x"), F.col("__y"), radius)
    cells = seen.groupBy(q.alias("q"), r.alias("r")).agg(F.count(F.lit(1)).alias("n"))
    most = cells.agg(F.max("n").alias("max_n"))  # one row
    return cells.join(F.broadcast(most), F.lit(True))
