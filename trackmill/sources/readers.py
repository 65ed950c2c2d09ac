"""Readers: point CSVs, run lists, GPX tracks, buoy texts and stored readings. Schemas are always given, never inferred."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import run_key, unit_name
from ..operators.tracks import micros

# Headers of the input files.
POINT_SCHEMA = "`Timestamp (from 1970)` double, date string, time string, Lat double, Long double, `Speed (m/s)` double, Heading double, HR int, `Distance (m)` double, `Calories (SUM)` double"
LIST_SCHEMA = ("`Timestamp (from 1970)` double, Date string, Time string, `Max Speed (kmh)` double, `Avg Speed (kmh)` double, `Duration (sec)` double, `Distance (km)` double, "
               "Name string, Desc string, Feeling bigint, `Equip 1` string, `Equip 2` string")  # fmt: skip
MS_TO_KMH = 3.6


def points(spark: SparkSession, path: str) -> DataFrame:
    """Normalised points of a folder of per-run CSVs; filename is the run key. Columns are taken by header."""
    raw = spark.read.schema(POINT_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    return normalise_points(raw.withColumn("__path", F.col("_metadata.file_path")))


def normalise_points(raw: DataFrame) -> DataFrame:
    """Renamed columns, speed in km/h, heart rate 0 as null; derived columns start empty."""
    return raw.select(
        run_key(F.col("__path")).alias("filename"), F.col("`Timestamp (from 1970)`").alias("tsi"), F.timestamp_micros(micros(F.col("`Timestamp (from 1970)`"))).alias("ts"), F.to_date("date").alias("date"), "time",
        F.col("Lat").alias("lat"), F.col("Long").alias("lon"), (F.col("`Speed (m/s)`") * MS_TO_KMH).alias("speed"), F.col("Heading").alias("heading"), F.nullif(F.col("HR"), F.lit(0)).alias("hr"),
        F.col("`Distance (m)`").alias("distance_orig"), F.col("`Calories (SUM)`").alias("calories"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("avg_speed_15s"), F.lit(0.0).alias("avg_speed_1k"))


def list_filename(ts: Column) -> Column:
    """`Waterspeed 2024-01-02 03.04.05` of epoch seconds (UTC)."""
    return F.date_format(F.timestamp_micros(micros(ts)), "'Waterspeed 'yyyy-MM-dd HH.mm.ss")


def run_list(spark: SparkSession, path: str) -> DataFrame:
    """Projected run list: filename, ts, date, time, speeds, duration, distance, name, description, feeling, board, foil."""
    return normalise_list(spark.read.schema(LIST_SCHEMA).option("header", True).option("enforceSchema", False).csv(path))


def normalise_list(raw: DataFrame) -> DataFrame:
    at = F.col("`Timestamp (from 1970)`")
    names = {"Max Speed (kmh)": "max_speed_kmh", "Avg Speed (kmh)": "avg_speed_kmh", "Duration (sec)": "duration_sec", "Distance (km)": "distance_km", "Name": "name", "Desc": "description", "Feeling": "feeling", "Equip 1": "board", "Equip 2": "foil"}
    return raw.select(list_filename(at).alias("filename"), at.alias("ts"), F.to_date("Date").alias("date"), F.col("Time").alias("time"), *[F.col(f"`{a}`").alias(b) for a, b in names.items()])


GPX_SCHEMA = T.StructType([T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()), T.StructField("ele", T.DoubleType()), T.StructField("time", T.StringType()), T.StructField("hdop", T.DoubleType()), T.StructField("extensions", T.StringType())])


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """filename, idx, time (timestamp), tsi, lat, lon, ele, hdop, hr of GPX track points.

    Points without a time are dropped; the rest are ordered by time, equal times as they stand in the file. hr is
    found at any depth below extensions, in any namespace.
    """
    raw = spark.read.format("xml").option("rowTag", "trkpt").option("ignoreNamespace", "true").schema(GPX_SCHEMA).load(path)
    hr = F.regexp_extract(F.col("extensions"), r"<(?:[A-Za-z0-9_.-]+:)?hr(?:\s[^>]*)?>\s*([0-9]+)", 1)
    rows = raw.select(
        F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("filename"), F.monotonically_increasing_id().alias("__at"), F.try_to_timestamp(F.trim("time")).alias("time"),
        F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele", "hdop", hr.try_cast("int").alias("hr")).filter("time IS NOT NULL")
    order = Window.partitionBy("filename").orderBy("time", "__at")
    rows = rows.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).withColumn("tsi", F.unix_micros("time") / 1_000_000)
    return rows.select("filename", "idx", F.col("idx").alias("seq"), "time", "tsi", "lat", "lon", "ele", "hdop", "hr")


# The columns taken from buoy texts.
BUOY_FIELDS = {"WVHT": ("wave_height", "float"), "DPD": ("wave_period", "float"), "MWD": ("wave_direction", "smallint"), "WTMP": ("water_temp", "float")}


def buoy(spark: SparkSession, path: str) -> DataFrame:
    """filename, ts, and value and unit of wave height, period, direction and water temperature of buoy texts.

    The first `#` line of a file names the columns, the second gives their units; values are looked up by name, and one
    that is no number (`MM`) is null.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("filename"), F.monotonically_increasing_id().alias("__at"), F.split(F.trim(F.regexp_replace("value", r"^#", "")), r"\s+").alias("f"), F.col("value").startswith("#").alias("head"), F.trim("value").alias("value"))
    heads = lines.filter("head").groupBy("filename").agg(F.sort_array(F.collect_list(F.struct("__at", "f"))).alias("h"))  # two short lines a file
    heads = heads.select("filename", F.col("h")[0]["f"].alias("names"), F.try_element_at("h", F.lit(2))["f"].alias("units"))
    rows = lines.filter("NOT head AND value != ''").join(heads, "filename")
    at = lambda name: F.array_position("names", name).cast("int")
    get = lambda array, name: F.when(at(name) > 0, F.try_element_at(array, F.nullif(at(name), F.lit(0))))
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", *[get("f", n) for n in ("YY", "MM", "DD")]), F.concat_ws(":", get("f", "hh"), get("f", "mm"))), F.lit("yyyy-MM-dd HH:mm"))
    out = rows.withColumn("ts", stamp)
    cols = [x for name, (into, kind) in BUOY_FIELDS.items() for x in (get("f", name).try_cast(kind).alias(into), unit_name(get("units", name)).alias(f"{into}_unit"))]
    return out.select("filename", "ts", *cols)


#: Spark's setting of how many tasks list a table's folders or a batch's files.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextlib.contextmanager
def listed_by_few(spark: SparkSession) -> Iterator[None]:
    """Many paths are listed by a task for each core: Spark would start one for each path, up to 10,000."""
    was = spark.conf.get(LISTING)
    spark.conf.set(LISTING, spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(LISTING, was)


def folders(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table of many folders, listed at once."""
    with listed_by_few(spark):
        return spark.read.schema(schema).option("header", True).csv(path)


def site_day(spark: SparkSession, path: str, schema: str, site: str, day: str) -> DataFrame:
    """Readings of one site and day of a CSV table partitioned by both: only that folder is read."""
    return spark.read.schema(schema + ", site string, day date").option("header", True).csv(path).filter((F.col("site") == site) & (F.col("day") == F.lit(day).cast("date")))


def run_points(spark: SparkSession, path: str, schema: str, run: str, key: str = "run_id") -> DataFrame:
    """One run's points of a CSV table partitioned by run, by tsi, with ts; where the run's name stands in its folder's as it is, no other folder is listed."""
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={run}")
    plain = re.fullmatch(r"[A-Za-z0-9_-]+", run) and own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(own)
    found = spark.read.schema(f"{schema}, {key} string").option("header", True).option("basePath", path).csv(own.toString() if plain else path)
    rows = found.filter(F.col(key) == run)
    return rows.withColumn("ts", F.timestamp_micros(micros(F.col("tsi")))).orderBy("tsi")
