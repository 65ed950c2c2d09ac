"""The registered queries: library functions over the fixture views, with rounded columns for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, conditions, crashes, dashboard, gpsclean, ingest, islands, matching, merge, nearest, pieces, runstats, segments, tracks
from . import fixtures
from .fixtures import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(*names: str, digits: int = 6) -> list[Column]:
    """Columns as doubles, rounded, under their own names."""
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


def n(*names: str) -> list[Column]:
    """As r(), but nudged, so that means that stand exactly between two roundings fall alike in both engines."""
    return [F.round(F.col(c) + 1e-9, 6).alias(c) for c in names]


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "track_points")


def dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_distance(pts(spark, sf_dir))


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_trailing_means(dist(spark, sf_dir))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).withColumn("filename", F.concat(F.lit("run "), F.col("run_id").cast("string"))).drop("run_id")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "run_list").withColumnRenamed("run_id", "id")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a region each, so that wind and swell have someone to go to."""
    third = F.col("run_id") % 3
    return view(spark, sf_dir, "run_list").withColumn("region", F.when(third == 0, "AFRICA").when(third == 1, "AMERICA").otherwise("ASIA"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    beaches = view(spark, sf_dir, "beaches")
    runs = view(spark, sf_dir, "run_list").join(matching.end_beaches(pts(spark, sf_dir), beaches), "run_id", "left")
    return matching.resolve_beaches(runs, beaches)


def info(spark: SparkSession, sf_dir: str, spread_s: int = 0, **limits: float) -> DataFrame:
    """Enriched runs, all from one pass over the points; spread_s: seconds put between runs, so that weeks differ."""
    stats = runstats.run_stats(means(spark, sf_dir)).withColumn("ts", F.col("ts") + F.col("run_id") * spread_s)
    beaches = view(spark, sf_dir, "beaches")
    ends = stats.withColumns({n: F.struct(F.col(f"{n}_lat").alias("lat"), F.col(f"{n}_lon").alias("lon")) for n in ("first", "last")}).withColumn("n", F.col("n_points"))
    return dashboard.enrich(matching.resolve_beaches(matching.with_beaches(ends, beaches), beaches), **limits)


#: Seconds between runs where a query needs several weeks.
WEEKS_S = 400_000
#: The share of the longest stretch beyond which a run of the fixtures counts as dry.
DRY = 0.262


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gpsclean.clean(pts(spark, sf_dir), speed_window_s=4)


@query
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runstats.run_stats(means(spark, sf_dir))
    return out.select("run_id", "ts", *r("max_speed_kmh", "avg_speed_kmh", "duration_sec", "distance_km"), "min_foiling_hr", *r("avg_foiling_hr"), *n("max_speed_1k"), *r("duration_on_foil", "distance_on_foil", "longest_segment_distance", "longest_segment_start", "longest_segment_end"), "paddle_up_count", *r("distance_to_first_paddle_up"))


@query
def distance_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist(spark, sf_dir).select("run_id", "seq", *r("step_m", "distance"))


@query
def trailing_mean_15s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(spark, sf_dir).select("run_id", "seq", *n("avg_speed_15s"))


@query
def trailing_mean_1k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(spark, sf_dir).select("run_id", "seq", *n("avg_speed_1k"))


def _in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with distance, made in pieces of half a minute."""
    return pieces.with_distance(pts(spark, sf_dir), piece_s=30)


@query
def distance_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_pieces(spark, sf_dir).select("run_id", "seq", *r("step_m", "distance"))


@query
def trailing_means_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distances as elsewhere, so that the same rows lie exactly at the end of a frame.
    return pieces.with_trailing_means(dist(spark, sf_dir), piece_s=30, piece_m=1000).select("run_id", "seq", *n("avg_speed_15s", "avg_speed_1k"))


@query
def islands_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.with_islands(_in_pieces(spark, sf_dir), piece_s=30).filter("__fast")
    found = rows.groupBy("run_id", "island").agg(F.min("tsi").alias("start_tsi"), F.max("tsi").alias("end_tsi"), F.min("distance").alias("start_distance"), (F.max("distance") - F.min("distance")).alias("distance"))
    return found.withColumn("duration", F.col("end_tsi") - F.col("start_tsi")).select("run_id", "island", *r("start_tsi", "end_tsi", "start_distance", "distance", "duration"))


@query
def crashes_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.crashes(pts(spark, sf_dir), piece_s=30).select("run_id", "seq", *r("tsi", "speed", "avg_speed"))


@query
def clean_hold_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions held over flagged rows, carried from piece to piece."""
    flagged = gpsclean.flag_positions(pts(spark, sf_dir))
    first = F.row_number().over(tracks.by_run()) == 1
    good = F.when(first | ~F.col("position_outlier"), F.struct("lat", "lon"))
    out = pieces.with_last(flagged.withColumn("__good", good), F.col("__good"), "held", piece_s=30)
    return out.select("run_id", "seq", *[F.round(F.col(f"held.{c}"), 7).alias(f"{c}_held") for c in ("lat", "lon")])


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.islands(dist(spark, sf_dir))


def _islands_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir).select("run_id", "island", *r("start_tsi", "end_tsi", "start_distance", "distance", "duration"))


QUERIES["islands"] = _islands_all


@query
def islands_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.island_stats(_islands(spark, sf_dir)).select("run_id", *r("longest_segment_distance", "longest_segment_start", "longest_segment_end"))


@query
def paddle_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.island_stats(_islands(spark, sf_dir)).select("run_id", "paddle_up_count").filter("paddle_up_count IS NOT NULL")


@query
def first_paddle_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.island_stats(_islands(spark, sf_dir)).filter("distance_to_first_paddle_up IS NOT NULL").select("run_id", *r("distance_to_first_paddle_up"))


@query
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_micros(tracks.micros(F.col("tsi")))
    points = dist(spark, sf_dir).withColumns({"date": F.to_date(at), "time": F.date_format(at, "HH:mm:ss")})
    return runstats.rollup(points).select("run_id", day("date"), "time", *r("ts", "max_speed_kmh", "avg_speed_kmh", "duration_sec", "distance_km"))


@query
def heart_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runstats.heart_rates(pts(spark, sf_dir)).select("run_id", "min_foiling_hr", *r("avg_foiling_hr"))


@query
def max_speed_1k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runstats.max_speed_1k(means(spark, sf_dir)).select("run_id", *n("max_speed_1k"))


@query
def foil_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runstats.foil_totals(dist(spark, sf_dir)).select("run_id", *r("duration_on_foil", "distance_on_foil"))


@query
def speed_and_heart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runstats.speed_and_heart(pts(spark, sf_dir)).select("run_id", *r("avg_foiling_speed", "avg_hr"), "max_hr")


@query
def heart_rate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).select("run_id", "seq", F.nullif(F.col("hr"), F.lit(0)).alias("hr"))


@query
def epoch_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).select("run_id", "seq", F.date_format(F.timestamp_micros(tracks.micros(F.col("tsi"))), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query
def normalise_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import normalise_points as normalise

    raw = pts(spark, sf_dir).withColumns({"__path": F.concat(F.lit("file:/in/run "), F.col("run_id").cast("string"), F.lit(".csv")), "Timestamp (from 1970)": F.col("tsi"), "date": F.lit("2024-01-01"), "time": F.col("seq").cast("string"),
                                          "Speed (m/s)": F.col("speed") / 3.6, "Distance (m)": F.lit(0.0), "Calories (SUM)": F.lit(0.0), "Heading": F.lit(0.0), "Long": F.col("lon")})
    return normalise(raw).select("filename", F.col("time").cast("long").alias("seq"), *r("tsi", "speed"), "hr", "distance")


def _on_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_land(pts(spark, sf_dir), view(spark, sf_dir, "coast_segments"))


@query
def nearest_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_land(spark, sf_dir).select("run_id", "seq", *r("nearest_land_lat", "nearest_land_lon"))


@query
def distance_to_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.distance_to_land(_on_land(spark, sf_dir)).select("run_id", "seq", *r("distance_to_land", digits=3))


@query
def furthest_from_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runstats.furthest_from_land(_on_land(spark, sf_dir)).select("run_id", *r("max_distance", digits=3))


@query
def end_beaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.end_beaches(pts(spark, sf_dir), view(spark, sf_dir, "beaches"))


@query
def resolved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("run_id", "start_beach", "end_beach", "region")


@query
def match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_runs(staged(spark, sf_dir), listed(spark, sf_dir))


@query
def unmatched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = staged(spark, sf_dir)
    return matching.unmatched(points, matching.match_runs(points, listed(spark, sf_dir).filter("id % 3 != 0")))


@query
def attach_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = staged(spark, sf_dir)
    return matching.attach_runs(points, matching.match_runs(points, listed(spark, sf_dir))).select("id", "filename", "seq")


@query
def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = listed(spark, sf_dir).withColumn("filename", F.concat(F.lit("run "), F.col("id").cast("string")))
    return matching.new_files(staged(spark, sf_dir), named, pts(spark, sf_dir).filter("run_id % 2 = 0")).select("filename").distinct()


@query
def upsert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "run_list").withColumn("filename", F.concat(F.lit("run "), F.col("run_id").cast("string")))
    old = named.filter("run_id % 2 = 0").select(F.concat(F.lit("id"), F.col("run_id").cast("string")).alias("id"), "filename", F.lit("Wing").alias("sport"), "ts", "duration_sec", F.lit(5.0).alias("max_distance"))
    new = named.filter("run_id % 3 != 0").select("filename", (F.col("ts") + 1).alias("ts"), (F.col("duration_sec") + 2).alias("duration_sec"))
    return merge.upsert(old, new, columns=("ts", "duration_sec"))


def _write_back(spark: SparkSession, sf_dir: str, mode: str, some: bool) -> DataFrame:
    runs = view(spark, sf_dir, "run_list").select("run_id", "duration_sec")
    if mode == "fill":
        runs = runs.withColumn("duration_sec", F.when(F.col("run_id") % 3 != 0, F.col("duration_sec")))
    stats = runstats.foil_totals(dist(spark, sf_dir)).select("run_id", F.col("duration_on_foil").alias("duration_sec"))
    return merge.apply_stats(runs, stats.filter("run_id % 2 = 0") if some else stats, "run_id", mode).select("run_id", *r("duration_sec"))


@query
def write_back_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _write_back(spark, sf_dir, "overwrite", True)


@query
def write_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _write_back(spark, sf_dir, "fill", False)


@query
def write_back_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _write_back(spark, sf_dir, "all", True)


@query
def import_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as the import makes them, of the files whose runs (those of odd number) have none yet."""
    named = listed(spark, sf_dir).withColumn("filename", F.concat(F.lit("run "), F.col("id").cast("string")))
    known = pts(spark, sf_dir).filter("run_id % 2 = 0").select("run_id")
    out = ingest.import_points(staged(spark, sf_dir), named, known, view(spark, sf_dir, "coast_segments"))
    return out.select("run_id", "filename", "seq", *r("distance", digits=4), *n("avg_speed_15s", "avg_speed_1k"), *r("nearest_land_lat", "nearest_land_lon"))


@query
def update_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics written back into runs that have some of them already."""
    some = lambda k, value, kind: F.when(F.col("id") % k == 0, F.lit(value)).cast(kind)
    runs = listed(spark, sf_dir).withColumns({
        "min_foiling_hr": F.when(F.col("id") % 3 < 2, 99).cast("int"), "avg_foiling_hr": some(3, 98.5, "double"), "max_distance": some(4, 1.5, "double"), "start_pos": some(5, 3, "long"),
        "end_pos": some(10, 4, "long"), "paddle_up_count": F.lit(77).cast("long"), "duration_on_foil": F.lit(5.5), "max_speed_1k": some(2, 12.5, "double")})
    points = nearest.nearest_land(means(spark, sf_dir), view(spark, sf_dir, "coast_segments"))
    out = ingest.update_runs(runs, points, view(spark, sf_dir, "beaches"))
    return out.select("id", "ts", "sport", *r("max_speed_kmh", "avg_speed_kmh", "duration_sec", "distance_km", "longest_segment_distance", "duration_on_foil", "distance_on_foil"), "paddle_up_count", *r("distance_to_first_paddle_up"), "min_foiling_hr", *n("avg_foiling_hr", "max_speed_1k"), *r("max_distance", digits=3), "start_pos", "end_pos")


@query
def similar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.similar_runs(resolved(spark, sf_dir)).select("run_id", "other", F.col("rank").cast("long").alias("rank"))


@query
def wind_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conditions.wind_by_run(regions(spark, sf_dir), view(spark, sf_dir, "wind"), fixtures.SITES)
    return out.select("run_id", *r("avg_wavg", "max_wavg", "avg_wgust", "max_wgust"), "avg_wdir")


@query
def run_list_with_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conditions.with_wind(regions(spark, sf_dir), view(spark, sf_dir, "wind"), fixtures.SITES)
    return out.select("run_id", "region", *r("avg_wavg", "max_wgust"), "avg_wdir")


def _wind_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.slice_for_runs(regions(spark, sf_dir), view(spark, sf_dir, "wind"), fixtures.SITES)


@query
def wind_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wind_slice(spark, sf_dir).select("run_id", "event_id", *r("tsi", "wavg", "wgust", "wdir"))


@query
def wind_slice_any_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind of each run with the last reading before it, however old: every run is there again 45 days later, when readings have ended."""
    runs = regions(spark, sf_dir)
    both = runs.unionByName(runs.withColumns({"run_id": F.col("run_id") + 100_000, "ts": F.col("ts") + 45 * 86_400}))
    return conditions.slice_for_runs(both, view(spark, sf_dir, "wind"), fixtures.SITES, same_day=False).select("run_id", "event_id", *r("tsi", "wavg"))


@query
def wind_slice_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind of each run's day in Hawaii."""
    out = conditions.slice_for_runs(regions(spark, sf_dir), view(spark, sf_dir, "wind"), fixtures.SITES, zone="Pacific/Honolulu")
    return out.select("run_id", "event_id", *r("tsi", "wavg"))


@query
def swell_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conditions.slice_for_runs(regions(spark, sf_dir), conditions.in_feet(view(spark, sf_dir, "swell")), fixtures.SWELL_SITES)
    return out.select("run_id", "event_id", *r("tsi", "wave_height", "wave_period"))


@query
def wind_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.relative_conditions(_wind_slice(spark, sf_dir)).select("run_id", "event_id", *r("t"))


@query
def wind_rose(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conditions.wind_rose(view(spark, sf_dir, "wind"), ["site"])
    return out.select("site", "sector", "start_deg", "compass", "bin", "label", "n", "sector_n", *r("r0", "r1", "share"))


def _crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crashes.crashes(dist(spark, sf_dir))


def _crash_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crashes(spark, sf_dir).select("run_id", "seq", *r("tsi", "speed", "avg_speed"))


QUERIES["crashes"] = _crash_rows


@query
def crash_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexagons of the crashes on a map of the fixture's waters, 960 by 600 pixels."""
    return crashes.density(_crashes(spark, sf_dir), scale=200_000, left=-2.7333, top=-0.376, width=960, height=600)


@query
def run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable texts of each run's statistics."""
    from ..functions import text

    runs = runstats.run_stats(means(spark, sf_dir))
    at = F.timestamp_seconds(F.col("ts"))
    return runs.select(
        "run_id", text.seconds(F.col("duration_sec")).alias("duration"), text.time_diff(F.col("ts"), F.col("ts") + F.col("duration_sec") * 70).alias("span"), text.pace(F.col("avg_speed_kmh")).alias("pace"), text.speed(F.col("max_speed_kmh")).alias("top"),
        text.heart_rate(F.col("avg_foiling_hr")).alias("heart"), text.distance(F.col("distance_on_foil")).alias("on_foil"), text.whole_or_unknown(F.col("paddle_up_count")).alias("ups"), text.wind(F.col("max_speed_1k"), F.col("max_speed_kmh"), F.col("run_id") % 3).alias("wind"),
        text.timestamp(at).alias("at"), text.comma(F.col("duration_sec").cast("long")).alias("comma"), text.foil_name(F.concat(F.lit("Foil "), F.col("run_id").cast("string"), F.lit(" 725.0 cm2"))).alias("foil"))


@query
def compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compass points of each wind reading in three finenesses."""
    from ..functions.geo import compass_point

    return view(spark, sf_dir, "wind").select("event_id", *[compass_point(F.col("wdir"), k).alias(f"p{k}") for k in (4, 8, 16)])


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(dist(spark, sf_dir))


@query
def on_off_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("run_id", "seq", "on_foil", "segment")


@query
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_stats(_segments(spark, sf_dir)).select("run_id", "segment", "on_foil", *r("duration", "distance", "max_speed", "avg_speed", "pace", "avg_hr"), "max_hr", "min_hr")


@query
def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.splits(dist(spark, sf_dir)).select("run_id", "split", *r("min_speed", "avg_speed", "max_speed"), "min_hr", *r("avg_hr"), "max_hr", *r("min_pace", "avg_pace", "max_pace"))


@query
def fastest_1k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.fastest(dist(spark, sf_dir)).select("run_id", *r("duration", "start_tsi", "end_tsi", "distance"))


@query
def callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.callouts(dist(spark, sf_dir)).select("run_id", "kind", *r("lat", "lon", "value"))


@query
def callout_furthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run is furthest from land."""
    points = nearest.distance_to_land(nearest.nearest_land(dist(spark, sf_dir), view(spark, sf_dir, "coast_segments")))
    return segments.callouts(points).filter("kind = 'furthest'").select("run_id", *r("value", digits=3))


@query
def segment_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance from land of each segment."""
    rows = nearest.distance_to_land(nearest.nearest_land(_segments(spark, sf_dir), view(spark, sf_dir, "coast_segments")))
    return segments.segment_stats(rows).select("run_id", "segment", *r("avg_land_distance", digits=3))


@query
def speed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.speed_classes(pts(spark, sf_dir)).select("run_id", "seq", "speed_class")


@query
def scaled_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.scaled_speed(pts(spark, sf_dir)).select("run_id", "seq", "shade", *r("scaled"))


@query
def split_on_foil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.split_on_foil(pts(spark, sf_dir)).select("run_id", "seq", *r("speed_on", "speed_off"))


@query
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.progress(dist(spark, sf_dir)).select("run_id", "seq", *r("elapsed", "done"))


@query
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.trend(pts(spark, sf_dir).withColumn("x", F.col("tsi") - 1704067200), "x", "speed", ["run_id"])
    return out.select("run_id", *r("slope", digits=9), *r("intercept", digits=4))


@query
def clean_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gpsclean.flag_positions(pts(spark, sf_dir)).select("run_id", "seq", "position_outlier", "position_outlier_reason")


@query
def clean_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gpsclean.hold_positions(gpsclean.flag_positions(pts(spark, sf_dir))).select("run_id", "seq", *r("lat_held", "lon_held", digits=7))


@query
def clean_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("run_id", "seq", *r("speed_2s"))


@query
def clean_hampel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("run_id", "seq", *r("speed_hampel"), "hampel_outlier")


@query
def clean_despike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("run_id", "seq", *r("speed_accel"), "accel_outlier")


@query
def clean_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("run_id", "seq", *r("speed_plateau"), "plateau_outlier")


@query
def clean_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("run_id", "seq", *r("speed_final"), "sanity_capped", *r("distance", digits=4))


@query
def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gpsclean.summary(cleaned(spark, sf_dir))
    return out.select(*[c for c in out.columns if c != "max_speed_final"], *r("max_speed_final"))


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query
def enriched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info(spark, sf_dir).select("run_id", day("month"), day("week"), "dry", *r("pct_dist_on_foil", "pct_time_on_foil"))


@query
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dashboard.totals(info(spark, sf_dir))
    tops = ("max_speed_kmh", "max_speed_1k", "longest_segment_distance")
    return out.select("n_runs", *r("sum_duration_sec", "sum_distance_km", digits=4), "sum_paddle_up_count", *n(*tops), *[f"{c}_run" for c in tops])


@query
def dashboard_totals_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals with the largest distance from land and its run."""
    runs = info(spark, sf_dir).join(runstats.furthest_from_land(_on_land(spark, sf_dir)), "run_id", "left")
    return dashboard.totals(runs).select("n_runs", *r("max_distance", digits=3), "max_distance_run")


@query
def landing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from each start beach to each end beach: one row per start, one column per beach of the table."""
    # The columns of a pivot are named by the table of beaches, one name for each.
    names = [x[0] for x in view(spark, sf_dir, "beaches").orderBy("beach_id").select("beach").collect()]
    out = dashboard.landing_matrix(info(spark, sf_dir), names)
    return out.select("start_beach", *[F.col(f"`{x}`").cast("long").alias(f"to_{i}") for i, x in enumerate(names)])


@query
def weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each week's best 1 km speed."""
    weeks = dashboard.weekly_band(info(spark, sf_dir, WEEKS_S)).withColumn("x", F.datediff("week", F.lit("2024-01-01").cast("date")) / 7)
    return segments.trend(weeks, "x", "high").select(*r("slope", "intercept", digits=5))


@query
def enriched_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foil names and the wind of enriched runs."""
    runs = conditions.with_wind(regions(spark, sf_dir), view(spark, sf_dir, "wind"), fixtures.SITES)
    named = runs.withColumns({"foil": F.when(F.col("run_id") % 4 > 0, F.concat(F.lit("Foil "), F.col("run_id").cast("string"), F.lit(" 725.0 cm2"))), **{c: F.lit(None).cast("double") for c in ("distance_on_foil", "distance_km", "duration_on_foil", "longest_segment_distance")}})
    out = dashboard.enrich(named)
    return out.select("run_id", "foil", *[F.round(f"wind_data.{c}", 6).alias(c) for c in ("avg_avg", "avg_max", "gust_avg", "gust_max")], F.col("wind_data.avg_dir").alias("avg_dir"))


@query
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by month, region, week and beach in one pass."""
    out = dashboard.overview(info(spark, sf_dir, WEEKS_S))
    return out.select("kind", day("month"), "region", day("week"), "start_beach", "end_beach", "n", *r("sum_duration_sec", "sum_distance_km", digits=4), "sum_paddle_up_count", *n("low_speed_1k", "high_speed_1k"), "first_run", "first_from", "first_to")


@query
def outings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.outings(info(spark, sf_dir)).select(day("month"), "region", "n", *r("duration_sec", digits=4), "month_n", *r("month_duration_sec", digits=4))


@query
def weekly_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.weekly_band(info(spark, sf_dir, WEEKS_S)).select(day("week"), *n("low", "high"), "n", "start_beach", "end_beach")


@query
def weekly_heart_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.weekly_heart_rates(info(spark, sf_dir, WEEKS_S)).select(day("week"), "low_min_foiling_hr", "high_min_foiling_hr", *r("low_avg_foiling_hr", "high_avg_foiling_hr"), "n")


@query
def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.launches(resolved(spark, sf_dir))


@query
def beach_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.beach_totals(resolved(spark, sf_dir))


@query
def beach_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.beach_names(resolved(spark, sf_dir))


@query
def dry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.dry_runs(info(spark, sf_dir, dry_limit=DRY)).select("run_id", "ts")


@query
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.newest_first(info(spark, sf_dir)).select("run_id", "ts")


@query
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.latest(info(spark, sf_dir)).select("run_id", "ts")


@query
def recent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(1704067200 + 16 * 86_400))
    return dashboard.recent_points(pts(spark, sf_dir), view(spark, sf_dir, "run_list"), as_of=now).select("run_id", "seq")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "run_list").select("run_id")
    pairs = runs.select(F.col("run_id").alias("left_run"), (F.col("run_id") + 1).alias("right_run"))
    return pairs.join(runs, F.col("right_run") == F.col("run_id"), "left_semi")


@query
def compare_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.compare_splits(segments.splits(dist(spark, sf_dir)), _neighbours(spark, sf_dir))
    return out.select("left_run", "right_run", "split", *r("left_avg_speed", "right_avg_speed", "top_speed"))


@query
def shared_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.shared_maxima(dist(spark, sf_dir), _neighbours(spark, sf_dir))
    return out.select("left_run", "right_run", *r("max_speed"), *r("max_distance", digits=4), *r("max_duration"))
