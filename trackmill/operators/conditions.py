"""Wind and swell of each run, and the wind rose.

Readings crowd on few sites, so joins never go by site alone: both sides are cut into hours, a run stands in each
hour of its interval, and the equi-join on (site, hour) spreads as finely as the readings do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import compass_point, wrap360

# The station of each region, and feet in a metre.
WIND_SITES = {"Kihei": "kihei", "Maui North Shore": "hookipa"}
SWELL_SITES = {"Maui North Shore": "pauwela"}
HOUR, DAY = 3600, 86_400
FEET = 3.2808399


def site_of(region: Column, sites: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, site in sites.items():
        out = F.when(region == name, site).otherwise(out)
    return out


def in_interval(runs: DataFrame, readings: DataFrame, begin: Column, end: Column, sites: Mapping[str, str], key: str = "run_id", carry: Mapping[str, Column] | None = None) -> DataFrame:
    """key, __begin, the columns of carry and the readings (site, tsi, ..) of each run (with region) from begin to end, both included.

    Readings that have a day, the UTC date of tsi by which they are stored, are met by it too, so that of a partitioned
    table only the days of the asked runs are read.
    """
    asked = runs.select(key, *[c.alias(n) for n, c in (carry or {}).items()], site_of(F.col("region"), sites).alias("__site"), begin.alias("__begin"), end.alias("__end")).filter("__site IS NOT NULL AND __begin <= __end")
    hours = asked.withColumn("__hour", F.explode(F.sequence(F.floor(F.col("__begin") / HOUR), F.floor(F.col("__end") / HOUR))))
    cut = readings.withColumn("__hour", F.floor(F.col("tsi") / HOUR))
    same = (F.col("__site") == F.col("site")) & (hours["__hour"] == cut["__hour"])
    if "day" in readings.columns:
        hours = hours.withColumn("__day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("__hour") / 24).cast("int")))
        same = (F.col("__site") == F.col("site")) & (F.col("__day") == F.col("day")) & (hours["__hour"] == cut["__hour"])
    met = hours.join(cut, same)
    return met.filter("tsi >= __begin AND tsi <= __end").drop("__site", "__end", "__hour", "__day")


def _last_before_day(readings: DataFrame, asked: DataFrame, tie: Column) -> DataFrame:
    """__site, __number (of a UTC day) and __before, the site's last reading before that day, of each of asked (__site, __number), however old.

    Readings are summed up to one for each site and day, so a site's window holds a row for each day.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in readings.columns])
    days = readings.groupBy(F.col("site").alias("__site"), F.floor(F.col("tsi") / DAY).alias("__number")).agg(F.max_by(whole, F.struct("tsi", tie)).alias("__last"))
    both = days.withColumn("__asked", F.lit(False)).unionByName(asked.distinct().withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("__site").orderBy("__number").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("__before", F.last("__last", ignorenulls=True).over(before)).filter("__asked AND __before IS NOT NULL").select("__site", "__number", "__before")


def circular_mean(degrees: Column) -> Column:
    """Whole degrees of the mean direction in [0, 360); null if the directions cancel out."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    return F.when((s == 0) & (c == 0), F.lit(None)).otherwise(F.pmod(F.rint(F.round(F.degrees(F.atan2(s, c)) + 360, 9)).cast("int"), F.lit(360)))


def wind_by_run(runs: DataFrame, wind: DataFrame, sites: Mapping[str, str] = WIND_SITES, lead_s: float = 30 * 60, key: str = "run_id") -> DataFrame:
    """Wind statistics of each run in a mapped region, nulls without readings; wind from lead_s before the start to the end."""
    met = in_interval(runs, wind, F.col("ts") - lead_s, F.col("ts") + F.col("duration_sec"), sites, key)
    stats = met.groupBy(key).agg(F.avg("wavg").alias("avg_wavg"), F.max("wavg").alias("max_wavg"), F.avg("wgust").alias("avg_wgust"), F.max("wgust").alias("max_wgust"), circular_mean(F.col("wdir")).alias("avg_wdir"))
    return runs.filter(site_of(F.col("region"), sites).isNotNull()).select(key).join(stats, key, "left")


def with_wind(runs: DataFrame, wind: DataFrame, sites: Mapping[str, str] = WIND_SITES, key: str = "run_id") -> DataFrame:
    """All runs with their wind statistics."""
    return runs.join(wind_by_run(runs, wind, sites, key=key), key, "left")


def slice_for_runs(runs: DataFrame, readings: DataFrame, sites: Mapping[str, str], key: str = "run_id", same_day: bool = True, lookback_s: float | None = None, zone: str = "UTC") -> DataFrame:
    """Readings of each run in [start, end] and the last one before; the first row's time is moved to the start.

    same_day keeps to readings of the start's day in zone; else the one before may be however old, or lookback_s at most. A
    run without any reading has no rows.
    """
    local = F.from_utc_timestamp(F.timestamp_seconds(F.col("ts")), zone)
    midnight = lambda t: F.unix_micros(F.to_utc_timestamp(t, zone)) / 1_000_000
    day, next_day = midnight(F.date_trunc("day", local)), midnight(F.date_trunc("day", local) + F.expr("INTERVAL 1 DAY"))
    today = F.floor(F.col("ts") / DAY) * DAY
    begin = day if same_day else today.cast("double") if lookback_s is None else F.col("ts") - lookback_s
    end = F.least(F.col("ts") + F.col("duration_sec"), next_day - 0.000001) if same_day else F.col("ts") + F.col("duration_sec")
    met = in_interval(runs, readings, begin, end, sites, key, {"__start": F.col("ts")}).drop("__begin")
    tie = F.col("event_id") if "event_id" in readings.columns else F.lit(0)
    if not same_day and lookback_s is None:
        # The last reading before the start's own day stands in where that day has none before the start.
        asked = runs.select(key, F.col("ts").alias("__start"), site_of(F.col("region"), sites).alias("__site"), F.floor(F.col("ts") / DAY).alias("__number")).filter("__site IS NOT NULL")
        older = asked.join(_last_before_day(readings, asked.select("__site", "__number"), tie), ["__site", "__number"])
        met = met.unionByName(older.select(key, "__start", "__before.*"))
    order = Window.partitionBy(key).orderBy(F.desc("tsi"), tie.desc())
    before = met.filter("tsi < __start").withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")
    rows = met.filter("tsi >= __start").unionByName(before)
    place = Window.partitionBy(key).orderBy("tsi", tie)
    return rows.withColumn("__rn", F.row_number().over(place)).withColumn("tsi", F.when(F.col("__rn") == 1, F.col("__start")).otherwise(F.col("tsi"))).drop("__rn", "__start")


def in_feet(swell: DataFrame) -> DataFrame:
    return swell.withColumn("wave_height", F.col("wave_height") * FEET)


def speed_bin(v: Column, breaks: Sequence[float]) -> Column:
    """Index of v's bin; null for a null or NaN, the last one for whatever no other bin holds (also below the first break)."""
    out = F.lit(len(breaks) - 1)
    for i in range(len(breaks) - 1):
        out = F.when((v >= breaks[i]) & (v < breaks[i + 1]), i).otherwise(out)
    return F.when(v.isNull() | F.isnan(v), F.lit(None)).otherwise(out).cast("int")


def bin_label(index: Column, breaks: Sequence[float]) -> Column:
    names = [f"{a}–{b}" for a, b in zip(breaks, breaks[1:], strict=False)] + [f"{breaks[-1]}+"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), index + 1)


def wind_rose(readings: DataFrame, by: Sequence[str] = (), sectors: int = 36, breaks: Sequence[float] = (0, 15, 20, 25, 30), normalize: bool = True) -> DataFrame:
    """by, sector, start_deg, compass, bin, label, n, sector_n, r0, r1 (stacked by bin), share in percent of each wind rose."""
    size = 360 / sectors
    rows = readings.filter(F.col("wdir").isNotNull() & ~F.isnan("wdir")).withColumns({"sector": F.floor(wrap360(F.col("wdir")) / size).cast("int"), "bin": speed_bin(F.coalesce("wavg", "wgust"), breaks)}).filter("bin IS NOT NULL")
    counts = rows.groupBy(*by, "sector", "bin").agg(F.count(F.lit(1)).alias("n"))
    of_sector, of_all = Window.partitionBy(*by, "sector"), Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    value = F.col("n") / F.sum("n").over(of_all) if normalize else F.col("n").cast("double")
    stacked = counts.withColumns({"sector_n": F.sum("n").over(of_sector), "__v": value, "share": F.col("n") * 100 / F.sum("n").over(of_all)})
    r1 = F.sum("__v").over(of_sector.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return stacked.withColumn("r1", r1).select(*by, "sector", (F.col("sector") * size).alias("start_deg"), compass_point(F.col("sector") * size, sectors).alias("compass"), "bin", bin_label(F.col("bin"), breaks).alias("label"), "n", "sector_n", (F.col("r1") - F.col("__v")).alias("r0"), "r1", "share")
