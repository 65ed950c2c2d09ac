"""Queries that write fixture tables as files and read them by the library's readers, writers and stream."""

from __future__ import annotations

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unit_name
from ..operators import dashboard, gpsclean, ingest, tracks
from ..sources import readers, sinks
from ..streaming import dropfolder
from . import queries
from .fixtures import view
from .queries import query, r
from .scratch import folder, named_files

#: Where time stands in queries of recent rows.
NOW = 1704067200 + 16 * 86_400


def _point_files(spark: SparkSession, sf_dir: str) -> str:
    """One CSV for each run, `run 3.csv`."""
    at = F.timestamp_micros(tracks.micros(F.col("tsi")))
    raw = queries.pts(spark, sf_dir).select(
        "run_id", F.col("tsi").alias("Timestamp (from 1970)"), F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH:mm:ss").alias("time"), F.col("lat").alias("Lat"), F.col("lon").alias("Long"), (F.col("speed") / 3.6).alias("Speed (m/s)"),
        F.lit(0.0).alias("Heading"), F.col("hr").alias("HR"), F.lit(0.0).alias("Distance (m)"), F.lit(0.0).alias("Calories (SUM)"))
    return named_files(raw, folder(spark, "runs"), "run_id", ["`Timestamp (from 1970)`"], "run {}.csv")


@query
def read_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.points(spark, _point_files(spark, sf_dir))
    return rows.select("filename", queries.day("date"), "time", *r("tsi", "lat", "lon", "speed"), "hr", "distance")


@query
def drop_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, streamed into a table in one go; a second call finds nothing new."""
    path, out = _point_files(spark, sf_dir), folder(spark, "streamed")
    for _ in range(2):
        dropfolder.ingest_all(dropfolder.point_stream(spark, path, f"{out}-archive"), f"{out}-state", lambda batch, number: batch.write.mode("append").parquet(out))
    return spark.read.parquet(out).select("filename", *r("tsi", "speed"), "hr")


@query
def drop_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and point files of two folders, imported as a stream; the first attempt fails once its points are written, and their batch runs again."""
    lists, store = folder(spark, "lists"), dropfolder.Store(spark, folder(spark, "store"), dropfolder.RUNS)
    _listed(spark, sf_dir).write.option("header", True).option("escape", "\"").csv(lists)
    points, coast = _point_files(spark, sf_dir), view(spark, sf_dir, "coast_segments")

    def fail(table: str, number: int) -> None:
        if table == "points":
            raise RuntimeError("an attempt that fails after writing")

    with contextlib.suppress(StreamingQueryException):
        dropfolder.import_drop(spark, lists, points, store, coast, after=fail)
    for _ in range(2):
        dropfolder.import_drop(spark, lists, points, store, coast)
    found = store.points().groupBy(F.col("run_id").alias("id"), F.col("filename").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("distance"))
    return found.join(store.runs().select("id", "filename", "sport", "ts"), "id").select("id", "file", "filename", "sport", *r("ts"), "n", *r("distance", digits=4))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_micros(tracks.micros(F.col("ts")))
    return view(spark, sf_dir, "run_list").select(
        F.col("ts").alias("Timestamp (from 1970)"), F.date_format(at, "yyyy-MM-dd").alias("Date"), F.date_format(at, "HH:mm:ss").alias("Time"), F.lit(30.5).alias("Max Speed (kmh)"), F.lit(20.0).alias("Avg Speed (kmh)"), F.col("duration_sec").alias("Duration (sec)"),
        (F.col("run_id") * 1.5).alias("Distance (km)"), F.concat(F.lit("Run, no. "), F.col("run_id").cast("string")).alias("Name"), F.lit("a \"quoted\" word").alias("Desc"), (F.col("run_id") % 5).alias("Feeling"), F.lit("Board").alias("Equip 1"), F.lit("Foil 725.0 cm2").alias("Equip 2"))


@query
def read_run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "list")
    _listed(spark, sf_dir).write.option("header", True).option("escape", "\"").csv(path)
    out = readers.run_list(spark, path)
    return out.select("filename", *r("ts", "max_speed_kmh", "duration_sec", "distance_km"), queries.day("date"), "time", "name", "feeling", "board", "foil")


@query
def list_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "run_list").select("run_id", readers.list_filename(F.col("ts")).alias("filename"))


@query
def read_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPX files written backwards in time; every fiftieth point has no time and is dropped, some have no heart rate."""
    at = F.date_format(F.timestamp_micros(tracks.micros(F.col("tsi"))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    time = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit("<time>"), at, F.lit("</time>")))
    heart = F.when(F.col("hr") == 0, "").otherwise(F.concat(F.lit("<extensions><x:TrackPointExtension xmlns:x=\"urn:x\"><x:hr>"), F.col("hr").cast("string"), F.lit("</x:hr></x:TrackPointExtension></extensions>")))
    text = F.concat(F.lit("<trkpt lat=\""), F.col("lat").cast("string"), F.lit("\" lon=\""), F.col("lon").cast("string"), F.lit("\"><ele>1</ele>"), time, F.lit("<hdop>"), F.col("hdop").cast("string"), F.lit("</hdop>"), heart, F.lit("</trkpt>"))
    rows = queries.pts(spark, sf_dir).select("run_id", (-F.col("seq")).alias("__order"), text.alias("line"))
    for place, line in ((-(1 << 40), "<gpx><trk><trkseg>"), (1 << 40, "</trkseg></trk></gpx>")):
        rows = rows.unionByName(view(spark, sf_dir, "run_list").select("run_id", F.lit(place).cast("long").alias("__order"), F.lit(line).alias("line")))
    found = readers.gpx(spark, named_files(rows, folder(spark, "gpx"), "run_id", ["__order"], "run_{}.gpx", lines=True))
    return found.select("filename", "idx", *r("tsi", "lat", "lon", "hdop"), "hr")


def _buoy_files(spark: SparkSession, sf_dir: str) -> str:
    """One text for each day, with its two lines of names and units; every tenth wave height is missing."""
    tenths = lambda c: F.concat(F.floor(F.col(c)).cast("string"), F.lit("."), F.pmod(F.floor(F.col(c) * 10), F.lit(10)).cast("string"))
    height = F.when(F.col("event_id") % 10 == 0, "MM").otherwise(tenths("wave_height"))
    at = F.date_format(F.timestamp_seconds(F.floor("tsi")), "yyyy MM dd HH mm")
    swell = view(spark, sf_dir, "swell").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    lines = swell.select("day", F.col("event_id").alias("__order"), F.concat_ws("  ", at, height, F.col("wave_period").cast("int").cast("string"), F.col("wave_direction").cast("int").cast("string"), tenths("water_temp")).alias("line"))
    heads = [swell.select("day").distinct().select("day", F.lit(i - 2).cast("long").alias("__order"), F.lit(text).alias("line")) for i, text in enumerate(("#YY  MM DD hh mm WVHT  DPD MWD WTMP", "#yr  mo dy hr mn m    sec degT degC"))]
    return named_files(lines.unionByName(heads[0]).unionByName(heads[1]), folder(spark, "buoy"), "day", ["__order"], "{}.txt", lines=True)


@query
def read_buoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.buoy(spark, _buoy_files(spark, sf_dir))
    return rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *r("wave_height", "wave_period", "water_temp", digits=1), F.col("wave_direction").cast("int").alias("wave_direction"), "wave_height_unit", "wave_period_unit", "wave_direction_unit", "water_temp_unit")


@query
def buoy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "table")
    sinks.buoy_rows(readers.buoy(spark, _buoy_files(spark, sf_dir)), out)
    back = spark.read.schema("ts string, wave_height double, wave_period double, wave_direction int, water_temp double").option("header", True).csv(out)
    return back.select("ts", *r("wave_height", "wave_period", "water_temp", digits=1), "wave_direction")


@query
def unit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit of a code that goes round with the nations' numbers."""
    codes = F.array(*[F.lit(c) for c in ("degT", "m/s", "sec", "hPa", "nmi", "ft", "na", "yr")])
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nations.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), unit_name(F.element_at(codes, (F.col("n_nationkey") % 8 + 1).cast("int"))).alias("unit"))


WIND = "tsi double, wavg double, wgust double, wlull double, wdir double, event_id long"


def _wind_folders(spark: SparkSession, sf_dir: str, gzip: bool = False) -> str:
    """Wind of the last 14 days before NOW, by site and day."""
    out = folder(spark, "wind")
    recent = dashboard.recent(view(spark, sf_dir, "wind"), 14, "tsi", F.timestamp_seconds(F.lit(NOW)))
    sinks.by_partition(recent, out, ["site", "day"], "tsi", gzip)
    return out


@query
def export_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = spark.read.schema(f"{WIND}, site string, day date").option("header", True).csv(_wind_folders(spark, sf_dir))
    return back.select("site", queries.day("day"), "event_id", *r("tsi", "wavg", "wgust", "wlull", "wdir"))


@query
def read_site_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.site_day(spark, _wind_folders(spark, sf_dir), WIND, "kihei", "2024-01-10")
    return found.select("site", queries.day("day"), "event_id", *r("tsi", "wavg"))


def _placed(found: DataFrame, key: str) -> DataFrame:
    """Rows of each file numbered as they stand; a gzipped file is read by one task, in order."""
    stands = F.monotonically_increasing_id()
    return found.withColumns({"__file": F.col("_metadata.file_path"), "__at": stands}).selectExpr("*", f"row_number() OVER (PARTITION BY {key} ORDER BY __file, __at) AS place")


@query
def export_gzip_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and rows of each partition, and the rows that stand out of order."""
    back = spark.read.schema(f"{WIND}, site string, day date").option("header", True).csv(_wind_folders(spark, sf_dir, gzip=True))
    rows = _placed(back, "site, day").selectExpr("*", "row_number() OVER (PARTITION BY site, day ORDER BY tsi) AS due", "rank() OVER (PARTITION BY site, day ORDER BY tsi) AS least")
    return rows.groupBy("site", "day").agg(F.countDistinct("__file").alias("files"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("place") < F.col("least")).alias("misplaced")).select("site", queries.day("day"), "files", "n", "misplaced")


def _exported(spark: SparkSession, sf_dir: str) -> str:
    out = folder(spark, "points")
    ingest.publish_points(nearest_points(spark, sf_dir), view(spark, sf_dir, "run_list"), out, as_of=F.timestamp_seconds(F.lit(NOW)))
    return out


def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries._on_land(spark, sf_dir).select("run_id", "seq", "tsi", "speed", "lat", "lon", "nearest_land_lat", "nearest_land_lon")


POINTS = "seq long, tsi double, speed double, lat double, lon double, nearest_land_lat double, nearest_land_lon double, distance_to_land double"


@query
def export_recent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = readers.folders(spark, _exported(spark, sf_dir), f"{POINTS}, run_id long")
    return back.select("run_id", "seq", *r("tsi"), *r("distance_to_land", digits=3))


@query
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each point in its run's exported file."""
    out = folder(spark, "sorted")
    sinks.by_partition(queries.pts(spark, sf_dir).select("run_id", "seq", "tsi"), out, ["run_id"], "tsi", gzip=True)
    back = readers.folders(spark, out, "seq long, tsi double, run_id long")
    return _placed(back, "run_id").select("run_id", "seq", F.col("place").cast("long").alias("place"))


@query
def export_ordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs exported to several files each: rows that stand out of order when files are read by name."""
    out = folder(spark, "ordered")
    sinks.by_partition(queries.pts(spark, sf_dir).select("run_id", "seq", "tsi"), out, ["run_id"], "tsi", gzip=True, files=3)
    back = readers.folders(spark, out, "seq long, tsi double, run_id long")
    rows = _placed(back, "run_id").selectExpr("*", "row_number() OVER (PARTITION BY run_id ORDER BY tsi, seq) AS due")
    return rows.groupBy("run_id").agg((F.countDistinct("__file") > 1).alias("several"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("place") != F.col("due")).alias("misplaced"))


@query
def read_run_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "points")
    sinks.by_partition(queries.pts(spark, sf_dir).select("run_id", "seq", "tsi", "speed"), out, ["run_id"], "tsi", files=3)
    return readers.run_points(spark, out, "seq long, tsi double, speed double", "1").select("seq", *r("tsi", "speed"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query
def track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a cleaned track file."""
    rows = gpsclean.track_rows(queries.cleaned(spark, sf_dir))
    return rows.select("run_id", "idx", "time_utc", "time_local", *r("lat_raw", "lon_filtered", "speed_2s_kmh", "speed_final_kmh", "distance_cumulative_m"), "hr", "position_outlier_reason", "sanity_capped")


@query
def export_cleaned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "cleaned")
    sinks.cleaned_tracks(gpsclean.track_rows(queries.cleaned(spark, sf_dir)), out)
    back = spark.read.option("header", True).csv(out)  # all text, as the columns stand by name
    return back.select(F.col("run_id").cast("long").alias("run_id"), F.col("idx").cast("long").alias("idx"), "time_utc", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("lat_filtered", "speed_final_kmh", "distance_cumulative_m")], F.col("hampel_outlier").cast("boolean").alias("hampel_outlier"))
