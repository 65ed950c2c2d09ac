"""Matching of imported files to runs, of runs to beaches, and of runs to similar runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid

#: Beaches that every end of a run is held against.
FEW_BEACHES = 256


def file_starts(points: DataFrame) -> DataFrame:
    """filename and first_tsi of each file: all that matching needs of the points."""
    return points.groupBy("filename").agg(F.min("tsi").alias("first_tsi"))


def match_files(starts: DataFrame, runs: DataFrame, tolerance_s: float = 300, sport: str = "Downwind") -> DataFrame:
    """filename, id: each file with every run of the sport that starts less than tolerance_s from the file's first fix.

    A band join by time buckets: a file looks into its own bucket and both neighbours.
    """
    near = starts.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("first_tsi") / tolerance_s) + d)))
    listed = runs.filter(F.col("sport") == sport).select("id", F.col("ts").alias("__ts"), F.floor(F.col("ts") / tolerance_s).alias("__b"))
    return near.join(listed, "__b").filter(F.abs(F.col("__ts") - F.col("first_tsi")) < tolerance_s).select("filename", "id")


def match_runs(points: DataFrame, runs: DataFrame, tolerance_s: float = 300, sport: str = "Downwind") -> DataFrame:
    """match_files() of points."""
    return match_files(file_starts(points), runs, tolerance_s, sport)


def unmatched(points: DataFrame, matches: DataFrame) -> DataFrame:
    """Files without a run. points may be file_starts() of them."""
    return points.select("filename").distinct().subtract(matches.select("filename"))


def require_matched(points: DataFrame, matches: DataFrame, shown: int = 20) -> None:
    """Raises if any file has no run, naming some."""
    names = [r[0] for r in unmatched(points, matches).orderBy("filename").limit(shown).collect()]
    if names:
        raise ValueError("Unmatched runs (no list entry within threshold): " + ", ".join(map(str, names)))


def attach_runs(points: DataFrame, matches: DataFrame) -> DataFrame:
    """points with the id of each run that their file matches; the planner picks the join by what matches turn out to weigh."""
    return points.join(matches, "filename")


def new_files(files: DataFrame, runs: DataFrame, points: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows of files whose file name is not that of a run which has points already."""
    known = runs.join(points.select(F.col(key).alias("id")), "id", "left_semi").select("filename")
    return files.join(known, "filename", "left_anti")


def resolve_beaches(runs: DataFrame, beaches: DataFrame) -> DataFrame:
    """runs plus start_beach, end_beach and region (of the start); runs lacking either beach vanish."""
    start = beaches.select(F.col("beach_id").alias("start_pos"), F.col("beach").alias("start_beach"), "region")
    end = beaches.select(F.col("beach_id").alias("end_pos"), F.col("beach").alias("end_beach"))
    kept = runs.select(*[c for c in runs.columns if c != "region"])
    return kept.join(start, "start_pos").join(end, "end_pos")


def run_ends(points: DataFrame, key: str = "run_id") -> DataFrame:
    """key, first and last (lat and lon of these fixes) and n, the number of fixes, of each run."""
    first = F.min_by(F.struct("lat", "lon"), F.struct("tsi", "seq"))
    last = F.max_by(F.struct("lat", "lon"), F.struct("tsi", "seq"))
    return points.groupBy(key).agg(first.alias("first"), last.alias("last"), F.count(F.lit(1)).alias("n"))


def end_beaches(points: DataFrame, beaches: DataFrame, key: str = "run_id", size: float = grid.SIZE) -> DataFrame:
    """key, start_pos, end_pos: the beaches nearest, in flat degrees, to each run's first and last fix (ties: the smaller id)."""
    return beaches_of(run_ends(points, key), beaches, key, size)


def beaches_of(ends: DataFrame, beaches: DataFrame, key: str = "run_id", size: float = grid.SIZE) -> DataFrame:
    """The same from ends: key, first and last (each lat and lon), n."""
    return with_beaches(ends, beaches, key, size).select(key, "start_pos", "end_pos")


def with_beaches(ends: DataFrame, beaches: DataFrame, key: str = "run_id", size: float = grid.SIZE) -> DataFrame:
    """ends (key, first, last, n, ..), one row a run, with start_pos and end_pos.

    Up to FEW_BEACHES (which is counted) travel to the ends as one row; of more, ends meet those near their own cell of a grid.
    """
    spots = beaches.select("beach_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lit(None).cast("double").alias("lat2"), F.lit(None).cast("double").alias("lon2"))
    last = F.when(F.col("n") > 1, F.col("last"))
    if spots.limit(FEW_BEACHES + 1).count() <= FEW_BEACHES:
        met = grid.attach_few(ends.withColumn("__last", last), spots, "beach_id", {"start_pos": "first", "end_pos": "__last"})
        return met.withColumns({c: F.col(f"{c}.id") for c in ("start_pos", "end_pos")}).drop("__last")
    each = F.array(*[F.struct(F.lit(which).alias("which"), place["lat"].alias("lat"), place["lon"].alias("lon")) for which, place in (("first", F.col("first")), ("last", last))])
    met = grid.attach(ends.select(key, F.explode(each).alias("e")).select(key, "e.*"), spots, "beach_id", size=size, name="__near")
    found = met.groupBy(key).agg(*[F.max(F.when(F.col("which") == which, F.col("__near.id"))).alias(name) for which, name in (("first", "start_pos"), ("last", "end_pos"))])
    return ends.join(found, key)


def similar_runs(runs: DataFrame, key: str = "run_id", everything: bool = False, of: object | None = None, top: int = 20) -> DataFrame:
    """key, other, other_ts, rank: the other runs that share a start or end beach with run `of` (or, with everything, all others), newest first.

    Without `of`, the newest `top` of each run: beaches are cut down to their newest runs first, so a popular beach never
    pairs all its runs.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("other_ts"), "other")
    if everything:
        if of is None:
            raise ValueError("all other runs are listed for one run at a time")
        pairs = runs.select(F.col(key).alias("other"), F.col("ts").alias("other_ts")).filter(F.col("other") != of).select(F.lit(of).alias(key), "other", "other_ts")
        return pairs.withColumn("rank", F.row_number().over(newest))
    # A row for each run and side, which own and other runs share: they are dealt out by side and beach once.
    sides = F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start_pos").alias("beach")), F.struct(F.lit("end").alias("side"), F.col("end_pos").alias("beach"))))
    at = runs.select(key, "ts", sides.alias("s")).select(key, "ts", "s.side", "s.beach").filter("beach IS NOT NULL").repartition("side", "beach")
    # A run's own row may be among the newest of its beach, hence one more.
    place = Window.partitionBy("side", "beach").orderBy(F.desc("ts"), key)
    some = at.select(F.col(key).alias("other"), F.col("ts").alias("other_ts"), "side", "beach")
    if of is None:
        newest_there = at.withColumn("__rn", F.row_number().over(place)).filter(F.col("__rn") <= top + 1)
        some = newest_there.select(F.col(key).alias("other"), F.col("ts").alias("other_ts"), "side", "beach")
    own = at.select(key, "side", "beach") if of is None else at.select(key, "side", "beach").filter(F.col(key) == of)
    pairs = own.join(some, ["side", "beach"]).filter(F.col(key) != F.col("other")).select(key, "other", "other_ts").dropDuplicates([key, "other"])
    ranked = pairs.withColumn("rank", F.row_number().over(newest))
    return ranked if of is not None else ranked.filter(F.col("rank") <= top)
