"""Upserts and write-backs as new tables: the caller writes them to a new place and swaps."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_COLUMNS = ("ts", "date", "time", "max_speed_kmh", "avg_speed_kmh", "duration_sec", "distance_km", "feeling", "board", "foil")


def hash_id(name: Column) -> Column:
    """An id in the shape of a UUID that depends on name alone, so a repeated import gives the same."""
    h = F.sha2(name.cast("binary"), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def upsert(runs: DataFrame, new: DataFrame, on: str = "filename", columns: Sequence[str] = LIST_COLUMNS, sport: str = "Downwind") -> DataFrame:
    """runs with the listed columns replaced where new has the key, and a row for each other key of new; other columns stay."""
    fresh = new.select(F.col(on).alias("__on"), F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = runs.withColumn("__old", F.lit(True)).join(fresh, F.col(on) == F.col("__on"), "full_outer")
    kept = {c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    out = both.withColumns(kept).withColumn(on, F.coalesce(on, "__on"))
    out = out.withColumns({c: F.when(F.col("__old").isNull(), v).otherwise(F.col(c)) for c, v in (("id", hash_id(F.col(on))), ("sport", F.lit(sport))) if c in runs.columns})
    return out.select(*runs.columns)


def apply_stats(runs: DataFrame, stats: DataFrame, key: str, mode: str, columns: Sequence[str] | None = None) -> DataFrame:
    """runs with columns from stats (one row per key).

    mode `overwrite`: where stats has the key; `fill`: there, and only in rows where one of the columns is null (then all of
    them); `all`: in every row, to null where stats lacks the key.
    """
    columns = [c for c in stats.columns if c != key] if columns is None else list(columns)
    side = stats.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = runs.join(side, F.col(key) == F.col("__key"), "left")
    for c in columns:
        if c not in runs.columns:
            joined = joined.withColumn(c, F.lit(None).cast(stats.schema[c].dataType))
    hit = F.coalesce("__hit", F.lit(False))
    if mode == "all":
        hit = F.lit(True)
    elif mode == "fill":
        missing = F.lit(False)
        for c in columns:
            missing = missing | F.col(c).isNull()
        hit = hit & missing
    elif mode != "overwrite":
        raise ValueError(mode)
    out = joined.withColumns({c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns})
    return out.select(*runs.columns, *[c for c in columns if c not in runs.columns])


def write_back(runs: DataFrame, stats: DataFrame, key: str, groups: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """runs with columns from stats (one row per key), in one join, each group of columns in its own mode.

    Modes as in apply_stats(), and `present`: where stats has a value for the group's first column.
    """
    columns = [c for _, group in groups for c in group]
    side = stats.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = runs.join(side, F.col(key) == F.col("__key"), "left")
    old = {c: F.col(c) if c in runs.columns else F.lit(None).cast(stats.schema[c].dataType) for c in columns}
    out = {}
    for mode, group in groups:
        hit = F.coalesce("__hit", F.lit(False))
        if mode == "all":
            hit = F.lit(True)
        elif mode == "present":
            hit = F.col(f"__{group[0]}").isNotNull()
        elif mode == "fill":
            hit = hit & functools.reduce(Column.__or__, [old[c].isNull() for c in group])
        elif mode != "overwrite":
            raise ValueError(mode)
        out |= {c: F.when(hit, F.col(f"__{c}")).otherwise(old[c]) for c in group}
    return joined.withColumns(out).select(*runs.columns, *[c for c in columns if c not in runs.columns])
