"""Outlier removal in GPS tracks: position checks, then five speed stages, each a window over one partitioning.

A track is the rows of one key ordered by tsi (in whole microseconds) and seq: one order for the row frames and the
time frames of all stages, so clean() sorts once. Each stage reads the column that the one before wrote; no row
of a stage depends on another row's correction in the same stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.geo import haversine_m
from .tracks import micros, with_distance


def _around(key: str, lo_s: float, hi_s: float) -> Window:
    return Window.partitionBy(key).orderBy("__us").rangeBetween(round(lo_s * 1_000_000), round(hi_s * 1_000_000))


def _order(key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy("__us", "seq")


def _timed(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage with __us there; what was not there before is dropped again."""

    @wraps(stage)
    def run(points: DataFrame, *args: object, **named: object) -> DataFrame:
        if "__us" in points.columns:
            return stage(points, *args, **named)
        return stage(points.withColumn("__us", micros(F.col("tsi"))), *args, **named).drop("__us")

    return run


@_timed
def flag_positions(points: DataFrame, key: str = "run_id", ratio: float = 2.5, min_m: float = 5, hdop_max: float = 5) -> DataFrame:
    """points plus position_outlier and position_outlier_reason (geometric, hdop, both or empty).

    Geometric: an inner row whose way via its own place is longer than min_m and than ratio times the direct way (> 0).
    """
    w = _order(key)
    way = lambda a, b: haversine_m(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon"))
    near = points.withColumns({f"__{s}{c}": f(c).over(w) for s, f in (("p", F.lag), ("n", F.lead)) for c in ("lat", "lon")})
    direct, via = way("__p", "__n"), way("__p", "") + way("", "__n")
    geo = F.coalesce((direct > 0) & (via > min_m) & (via > direct * ratio), F.lit(False))
    hdop = F.coalesce(F.col("hdop") > hdop_max, F.lit(False))
    reason = F.when(geo & hdop, "both").when(geo, "geometric").when(hdop, "hdop").otherwise("")
    return near.withColumns({"position_outlier": geo | hdop, "position_outlier_reason": reason}).select(*points.columns, "position_outlier", "position_outlier_reason")


@_timed
def hold_positions(points: DataFrame, key: str = "run_id") -> DataFrame:
    """points plus lat_held and lon_held: the last good position; a flagged first row counts as good."""
    w = _order(key)
    good = F.when(~F.col("position_outlier") | (F.row_number().over(w) == 1), F.struct("lat", "lon"))
    held = points.withColumn("__good", good).withColumn("__held", F.last("__good", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return held.withColumns({"lat_held": F.col("__held.lat"), "lon_held": F.col("__held.lon")}).drop("__good", "__held")


@_timed
def instant_speed(points: DataFrame, key: str = "run_id", window_s: float = 2) -> DataFrame:
    """points plus speed_2s: km/h from the earliest row within window_s; 0 if no time has passed since."""
    # Rows at one time share the frame's start, which is all that is taken from it.
    start = F.min(F.struct("__us", "seq", "lat_held", "lon_held")).over(_around(key, -window_s, 0))
    timed = points.withColumn("__first", start)
    seconds = (F.col("__us") - F.col("__first.__us")) / 1_000_000
    way = haversine_m(F.col("__first.lat_held"), F.col("__first.lon_held"), F.col("lat_held"), F.col("lon_held"))
    return timed.withColumn("speed_2s", F.coalesce(F.try_divide(way, seconds) * 3.6, F.lit(0.0))).drop("__first")


def median(values: Column) -> Column:
    """Median of a sorted array; null if it is empty."""
    n = F.size(values)
    return (F.try_element_at(values, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(values, F.floor(n / 2 + 1).cast("int"))) / 2


@_timed
def hampel(points: DataFrame, key: str = "run_id", column: str = "speed_2s", window_s: float = 12, z: float = 4, min_abs: float = 8, floor: float = 3) -> DataFrame:
    """points plus speed_hampel and hampel_outlier: values far from the window's median, by its MAD, give way to the median."""
    local = F.sort_array(F.collect_list(column).over(_around(key, -window_s, window_s)))
    rows = points.withColumn("__local", local).withColumn("__med", median(F.col("__local")))
    rows = rows.withColumn("__mad", median(F.sort_array(F.transform("__local", lambda x: F.abs(x - F.col("__med"))))))
    off = F.abs(F.col(column) - F.col("__med"))
    score = off / (F.greatest(F.col("__mad"), F.lit(floor / 1.4826)) * 1.4826)
    hit = F.coalesce((F.size("__local") >= 3) & (score > z) & (off > min_abs), F.lit(False))
    return rows.withColumns({"speed_hampel": F.when(hit, F.col("__med")).otherwise(F.col(column)), "hampel_outlier": hit}).drop("__local", "__med", "__mad")


@_timed
def despike(points: DataFrame, key: str = "run_id", column: str = "speed_hampel", max_accel: float = 20, max_gap_s: float = 3) -> DataFrame:
    """points plus speed_accel and accel_outlier: rows between a steep rise and a steep fall (or the other way) are interpolated in time."""
    w = _order(key)
    rows = points.withColumns({"__p": F.lag(column).over(w), "__n": F.lead(column).over(w), "__in": F.lag("__us").over(w), "__out": F.lead("__us").over(w)})
    before, after = (F.col("__us") - F.col("__in")) / 1_000_000, (F.col("__out") - F.col("__us")) / 1_000_000
    up, down = F.try_divide(F.col(column) - F.col("__p"), before), F.try_divide(F.col("__n") - F.col(column), after)
    close = (before > 0) & (after > 0) & (before <= max_gap_s) & (after <= max_gap_s)
    hit = F.coalesce(close & (F.abs(up) > max_accel) & (F.abs(down) > max_accel) & ((up > 0) != (down > 0)), F.lit(False))
    between = F.col("__p") + (F.col("__n") - F.col("__p")) * F.try_divide(before, before + after)
    return rows.withColumns({"speed_accel": F.when(hit, between).otherwise(F.col(column)), "accel_outlier": hit}).drop("__p", "__n", "__in", "__out")


@_timed
def deplateau(points: DataFrame, key: str = "run_id", column: str = "speed_accel", near_s: float = 3, far_s: float = 10, spike: float = 8, match: float = 8) -> DataFrame:
    """points plus speed_plateau, plateau_outlier, pre_flank, post_flank: a row that stands out from two like flanks gives way to their mean; without both flanks neither counts."""
    middle = lambda lo, hi: F.percentile(column, F.lit(0.5)).over(_around(key, lo, hi))
    rows = points.withColumns({"__pre": middle(-far_s, -near_s), "__post": middle(near_s, far_s)})
    both = F.col("__pre").isNotNull() & F.col("__post").isNotNull()
    rows = rows.withColumns({"pre_flank": F.when(both, F.col("__pre")), "post_flank": F.when(both, F.col("__post"))})
    hit = F.coalesce((F.abs(F.col("pre_flank") - F.col("post_flank")) < match) & (F.abs(F.col(column) - F.col("pre_flank")) > spike) & (F.abs(F.col(column) - F.col("post_flank")) > spike), F.lit(False))
    return rows.withColumns({"speed_plateau": F.when(hit, (F.col("pre_flank") + F.col("post_flank")) / 2).otherwise(F.col(column)), "plateau_outlier": hit}).drop("__pre", "__post")


def cap(points: DataFrame, column: str = "speed_plateau", ceiling: float = 65) -> DataFrame:
    """points plus speed_final and sanity_capped: above the ceiling the flanks' mean, else the one flank, else the ceiling."""
    hit = F.coalesce(F.col(column) > ceiling, F.lit(False))
    instead = F.coalesce((F.col("pre_flank") + F.col("post_flank")) / 2, F.col("pre_flank"), F.col("post_flank"), F.lit(float(ceiling)))
    return points.withColumns({"speed_final": F.when(hit, instead).otherwise(F.col(column)), "sanity_capped": hit})


def clean(points: DataFrame, key: str = "run_id", ratio: float = 2.5, min_m: float = 5, hdop_max: float = 5, speed_window_s: float = 2, hampel_window_s: float = 12, ceiling: float = 65) -> DataFrame:
    """All stages, with distance from the held positions."""
    points = points.withColumn("__us", micros(F.col("tsi")))
    rows = hold_positions(flag_positions(points, key, ratio, min_m, hdop_max), key)
    rows = despike(hampel(instant_speed(rows, key, speed_window_s), key, window_s=hampel_window_s), key)
    return with_distance(cap(deplateau(rows, key), ceiling=ceiling), key, "lat_held", "lon_held", _order(key)).drop("__us")


# The columns of a cleaned track file.
OUTPUT = ("idx time_utc time_local lat_raw lon_raw lat_filtered lon_filtered ele_m hr hdop position_outlier position_outlier_reason speed_2s_kmh speed_hampel_kmh hampel_outlier "
          "speed_accel_kmh accel_outlier speed_plateau_kmh plateau_outlier speed_final_kmh sanity_capped distance_cumulative_m").split()  # fmt: skip


def track_rows(cleaned: DataFrame, key: str = "run_id", zone: str = "Pacific/Honolulu") -> DataFrame:
    """key and the 22 columns of a cleaned track file, speeds rounded to 3 decimals and distance to 2."""
    utc = F.timestamp_micros(micros(F.col("tsi")))
    hours = F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd'T'HH:mm:ss")
    shift = (F.unix_timestamp(F.from_utc_timestamp(utc, zone)) - F.unix_timestamp(utc)).cast("int")
    offset = F.concat(F.when(shift < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(shift) / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(F.abs(shift) % 3600 / 60).cast("string"), 2, "0"))
    part = F.when(F.pmod(micros(F.col("tsi")), F.lit(1_000_000)) > 0, F.format_string(".%06d", F.pmod(micros(F.col("tsi")), F.lit(1_000_000)))).otherwise("")
    made = {"idx": F.col("seq"), "time_utc": F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00")), "time_local": F.concat(hours, part, offset), "lat_raw": F.col("lat"), "lon_raw": F.col("lon"),
            "lat_filtered": F.col("lat_held"), "lon_filtered": F.col("lon_held"), "ele_m": F.col("ele") if "ele" in cleaned.columns else F.lit(None).cast("double"), "distance_cumulative_m": F.round("distance", 2)}
    made |= {f"{c}_kmh": F.round(c, 3) for c in ("speed_2s", "speed_hampel", "speed_accel", "speed_plateau", "speed_final")}
    return cleaned.select(key, *[made.get(c, F.col(c) if c in cleaned.columns else F.lit(None)).alias(c) for c in OUTPUT])


def summary(cleaned: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows, rows flagged by each stage and largest final speed of each track."""
    flags = ("position_outlier", "hampel_outlier", "accel_outlier", "plateau_outlier", "sanity_capped")
    return cleaned.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(f).alias(f"n_{f}") for f in flags], F.max("speed_final").alias("max_speed_final"))
