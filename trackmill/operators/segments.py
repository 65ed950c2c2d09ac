"""Debounced on/off segments, fastest kilometre, per-kilometre splits, call-outs and speed classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tracks import by_run


def segments(points: DataFrame, key: str = "run_id", limit: float = 11, confirm_s: float = 5) -> DataFrame:
    """points plus on_foil and segment. The state flips only after the opposite signal (speed >= limit; null: no) has held confirm_s; a segment starts at the confirming row.

    A pending flip begins at the first row of a stretch of equal signals and ends with it, so it is confirmed at the first
    row of the stretch that is confirm_s or more from its start: the state is the last signal so confirmed.
    """
    w = by_run(key)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    raw = points.withColumn("__raw", F.coalesce(F.col("speed") >= limit, F.lit(False)))
    turned = raw.withColumns({"__turn": F.when(F.lag("__raw").over(w) == F.col("__raw"), 0).otherwise(1), "__rn": F.row_number().over(w)})
    stretch = turned.withColumn("__isl", F.sum("__turn").over(running))
    since = stretch.withColumn("__since", F.col("tsi") - F.min("tsi").over(Window.partitionBy(key, "__isl")))
    sure = since.withColumn("__sure", F.when((F.col("__rn") == 1) | (F.col("__since") >= confirm_s), F.col("__raw")))
    state = sure.withColumn("on_foil", F.last("__sure", ignorenulls=True).over(running))
    flip = state.withColumn("__flip", F.when(F.lag("on_foil").over(w) == F.col("on_foil"), 0).otherwise(1))
    return flip.withColumn("segment", F.sum("__flip").over(running)).select(*points.columns, "on_foil", "segment")


def segment_stats(rows: DataFrame, key: str = "run_id") -> DataFrame:
    """Statistics of each segment of rows from segments(); distance_to_land is used if it is there."""
    hr = F.nullif(F.col("hr"), F.lit(0))
    land = [F.avg("distance_to_land").alias("avg_land_distance")] if "distance_to_land" in rows.columns else []
    return rows.groupBy(key, "segment").agg(
        F.first("on_foil").alias("on_foil"), F.min("tsi").alias("start_tsi"), F.max("tsi").alias("end_tsi"), (F.max("tsi") - F.min("tsi")).alias("duration"), (F.max("distance") - F.min("distance")).alias("distance"),
        F.max("speed").alias("max_speed"), F.avg("speed").alias("avg_speed"), F.try_divide(F.lit(60.0), F.avg("speed")).alias("pace"), F.avg(hr).alias("avg_hr"), F.max(hr).alias("max_hr"), F.min(hr).alias("min_hr"), *land)


def splits(points: DataFrame, key: str = "run_id", metres: float = 1000) -> DataFrame:
    """Speed, pace (minutes a kilometre) and heart rate of each kilometre, numbered from 1."""
    hr = F.nullif(F.col("hr"), F.lit(0))
    rows = points.groupBy(key, (F.floor(F.col("distance") / metres) + 1).cast("long").alias("split")).agg(
        F.min("speed").alias("min_speed"), F.avg("speed").alias("avg_speed"), F.max("speed").alias("max_speed"), F.min(hr).alias("min_hr"), F.avg(hr).alias("avg_hr"), F.max(hr).alias("max_hr"))
    pace = lambda c: F.try_divide(F.lit(60.0), F.col(c))
    return rows.withColumns({"min_pace": pace("max_speed"), "avg_pace": pace("avg_speed"), "max_pace": pace("min_speed")})


def fastest(points: DataFrame, key: str = "run_id", metres: float = 1000) -> DataFrame:
    """The least time from a row to the first later row at least metres on: key, start_*, end_*, duration; the earliest start wins ties; no row for a run that never gets so far.

    Distance never falls along a run, so those rows are the frame up to -metres when ordered from the far end; that frame
    starts unbounded and is aggregated once, not anew for each row.
    """
    ahead = Window.partitionBy(key).orderBy(F.desc("distance")).rangeBetween(Window.unboundedPreceding, -metres)
    end = F.min(F.struct("tsi", "seq", "distance", "lat", "lon")).over(ahead)
    met = points.withColumn("__end", end).filter(F.col("__end").isNotNull())
    # The frame's edge is -distance <= -own - metres; one rounding step from distance - own >= metres.
    met = met.filter(F.col("__end.distance") - F.col("distance") >= metres * (1 - 1e-12))
    best = met.groupBy(key).agg(F.min(F.struct((F.col("__end.tsi") - F.col("tsi")).alias("duration"), "tsi", "seq", "lat", "lon", "distance", "__end")).alias("b"))
    return best.select(key, F.col("b.duration").alias("duration"), F.col("b.tsi").alias("start_tsi"), F.col("b.lat").alias("start_lat"), F.col("b.lon").alias("start_lon"), F.col("b.__end.tsi").alias("end_tsi"),
                       F.col("b.__end.lat").alias("end_lat"), F.col("b.__end.lon").alias("end_lon"), (F.col("b.__end.distance") - F.col("b.distance")).alias("distance"))


def callouts(points: DataFrame, key: str = "run_id", limit: float = 11, hr_limit: float = 15) -> DataFrame:
    """key, kind, lat, lon, value of the spots worth a mark: top speed, furthest from land, least foiling heart rate (if any), start and end of the fastest kilometre; ties go to the earliest row."""
    hr = F.nullif(F.col("hr"), F.lit(0))
    least = points.groupBy(key).agg(F.min(F.when(F.col("speed") > hr_limit, hr)).alias("__min_hr"))
    rows = points.join(least, key)
    at = F.struct("lat", "lon")
    early = F.struct((-F.col("tsi")).alias("t"), (-F.col("seq")).alias("s"))
    calm = (F.col("speed") > limit) & (hr == F.col("__min_hr"))
    land = "distance_to_land" in points.columns
    spots = [F.struct(F.lit("top_speed").alias("kind"), F.max_by(at, F.struct("speed", early)).alias("at"), F.max("speed").alias("value")),
             F.struct(F.lit("least_heart_rate").alias("kind"), F.min_by(at, F.when(calm, F.struct("tsi", "seq"))).alias("at"), F.min(F.when(calm, hr)).cast("double").alias("value"))]
    if land:
        spots.append(F.struct(F.lit("furthest").alias("kind"), F.max_by(at, F.struct("distance_to_land", early)).alias("at"), F.max("distance_to_land").alias("value")))
    marks = rows.groupBy(key).agg(F.array(*spots).alias("all")).select(key, F.explode("all").alias("m")).select(key, "m.kind", "m.at.lat", "m.at.lon", "m.value").filter("value IS NOT NULL")
    fast = fastest(points, key)
    ends = [fast.select(key, F.lit(f"{e}_of_fastest").alias("kind"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_tsi").alias("value")) for e in ("start", "end")]
    return marks.unionByName(ends[0]).unionByName(ends[1])


def speed_classes(points: DataFrame, key: str = "run_id", limit: float = 11, classes: int = 6) -> DataFrame:
    """points plus speed_class: 0 off foil (not above limit), else 1 to classes by exact quantiles of the run's speeds above limit."""
    cuts = points.filter(F.col("speed") > limit).groupBy(key).agg(F.expr(f"percentile(speed, array({', '.join(f'{i}/{classes}D' for i in range(1, classes))}))").alias("__cuts"))
    number = F.size(F.filter("__cuts", lambda c: c <= F.col("speed") + 1e-9)) + 1
    return points.join(cuts, key, "left").withColumn("speed_class", F.when(F.col("speed") > limit, number).otherwise(0).cast("int")).drop("__cuts")


def scaled_speed(points: DataFrame, key: str = "run_id", limit: float = 11) -> DataFrame:
    """points plus scaled (0 to 1 between the run's least and largest speed; 0.5 for a single speed; null off foil or unknown) and shade (unknown, off, on)."""
    w = Window.partitionBy(key)
    low, high = F.min("speed").over(w), F.max("speed").over(w)
    share = F.coalesce(F.try_divide(F.col("speed") - low, high - low), F.lit(0.5))
    return points.withColumns({"shade": F.when(F.col("speed").isNull(), "unknown").when(F.col("speed") < limit, "off").otherwise("on"), "scaled": F.when(F.col("speed") >= limit, share)})


def trend(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of the least-squares line of y on x."""
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
