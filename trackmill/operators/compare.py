"""Comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tracks import relative

SPLIT_COLUMNS = ("avg_speed", "max_speed", "avg_pace", "avg_hr")


def compare_splits(splits: DataFrame, pairs: DataFrame, key: str = "run_id") -> DataFrame:
    """left_run, right_run, split and both runs' split columns side by side, with the larger speed of each kilometre.

    pairs: left_run, right_run. A split that one run lacks has nulls there.
    """
    def side(name: str) -> DataFrame:
        cols = [F.col(c).alias(f"{name}_{c}") for c in SPLIT_COLUMNS]
        return pairs.join(splits, F.col(f"{name}_run") == F.col(key)).select("left_run", "right_run", "split", *cols)

    both = side("left").join(side("right"), ["left_run", "right_run", "split"], "full_outer")
    return both.withColumn("top_speed", F.greatest("left_max_speed", "right_max_speed"))


def shared_maxima(points: DataFrame, pairs: DataFrame, key: str = "run_id") -> DataFrame:
    """Of each pair: the larger of both runs' top speeds, distances and durations (scales of a common chart)."""
    own = points.groupBy(key).agg(F.max("speed").alias("v"), F.max("distance").alias("d"), (F.max("tsi") - F.min("tsi")).alias("t"))
    left, right = (own.select(F.col(key).alias(f"{s}_run"), *[F.col(c).alias(f"{s}_{c}") for c in "vdt"]) for s in ("left", "right"))
    both = pairs.join(left, "left_run").join(right, "right_run")
    top: list[Column] = [F.greatest(f"left_{c}", f"right_{c}").alias(n) for c, n in (("v", "max_speed"), ("d", "max_distance"), ("t", "max_duration"))]
    return both.select("left_run", "right_run", *top)


def relative_conditions(slices: DataFrame, key: str = "run_id") -> DataFrame:
    """Readings of each run with the time since its first one, so that two runs' series can be laid over each other."""
    return relative(slices, key)
