"""Readers, writers and the drop folder on small files."""

from __future__ import annotations

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trackmill.functions import text
from trackmill.operators import conditions, gpsclean, ingest
from trackmill.plans import scratch
from trackmill.sources import readers, sinks
from trackmill.streaming import dropfolder

HEAD = "Timestamp (from 1970),date,time,Lat,Long,Speed (m/s),Heading,HR,Distance (m),Calories (SUM)\n"
BUOY = """#YY  MM DD hh mm WDIR WSPD GST  WVHT  DPD  APD MWD  PRES  ATMP  WTMP  DEWP  VIS PTDY  TIDE
#yr  mo dy hr mn degT m/s  m/s     m  sec  sec degT  hPa  degC  degC  degC  nmi  hPa    ft
2025 01 02 03 26   MM   MM   MM   2.4    8  6.1  51    MM    MM  25.4    MM   MM   MM    MM
2025 01 02 03 56   MM   MM   MM   MM     9  6.1  MM    MM    MM  25.5    MM   MM   MM    MM
"""
BUOY2 = """#YY  MM DD hh mm WTMP MWD DPD WVHT
#yr  mo dy hr mn degC degT na m
2025 02 03 04 05 20.5 359 7 1.5
"""
GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:x="urn:x"><trk><trkseg>
<trkpt lat="20.2" lon="-156.2"><ele>1</ele><time>2025-01-01T00:00:02Z</time><hdop>1.5</hdop><extensions><x:TrackPointExtension><x:hr>120</x:hr></x:TrackPointExtension></extensions></trkpt>
<trkpt lat="20.3" lon="-156.3"><ele>2</ele></trkpt>
<trkpt lat="20.1" lon="-156.1"><time>2025-01-01T00:00:01Z</time></trkpt>
<trkpt lat="20.4" lon="-156.4"><time>2025-01-01T00:00:02Z</time></trkpt>
</trkseg></trk></gpx>"""


def write(folder, name, body):
    (folder / name).write_text(body)


def test_point_files(spark, tmp_path):
    write(tmp_path, "Run 1.csv", HEAD + "1704067200.5,2024-01-01,00:00:00,20.8,-156.6,5,90,0,1,2\n1704067201.5,2024-01-01,00:00:01,20.9,-156.6,5.5,91,120,1,2\n")
    rows = readers.points(spark, str(tmp_path)).orderBy("tsi").collect()
    assert [r.filename for r in rows] == ["Run 1", "Run 1"] and rows[0].speed == 18.0 and [r.hr for r in rows] == [None, 120]
    assert rows[0].ts == datetime.datetime(2024, 1, 1, 0, 0, 0, 500000) and rows[0].distance == 0.0


def test_run_list(spark, tmp_path):
    write(tmp_path, "list.csv", "Timestamp (from 1970),Date,Time,Max Speed (kmh),Avg Speed (kmh),Duration (sec),Distance (km),Name,Desc,Feeling,Equip 1,Equip 2\n1704164645,2024-01-02,03:04:05,30,20,3600,20,n,d,5,B,F 725.0 cm2\n")
    r = readers.run_list(spark, str(tmp_path)).first()
    assert r.filename == "Waterspeed 2024-01-02 03.04.05" and r.board == "B" and r.feeling == 5 and r.name == "n"


def test_gpx(spark, tmp_path):
    write(tmp_path, "a.gpx", GPX)
    write(tmp_path, "b.gpx", GPX.replace("<extensions>", "<nothing>").replace("</extensions>", "</nothing>"))
    rows = sorted(readers.gpx(spark, str(tmp_path)).collect(), key=lambda r: (r.filename, r.idx))
    assert [(r.filename, r.idx, r.lat, r.hr) for r in rows] == [("a.gpx", 0, 20.1, None), ("a.gpx", 1, 20.2, 120), ("a.gpx", 2, 20.4, None), ("b.gpx", 0, 20.1, None), ("b.gpx", 1, 20.2, None), ("b.gpx", 2, 20.4, None)]
    assert rows[1].hdop == 1.5 and rows[1].ele == 1.0


def test_cleaned_track_file(spark, tmp_path):
    write(tmp_path, "a.gpx", GPX)
    out = gpsclean.track_rows(gpsclean.clean(readers.gpx(spark, str(tmp_path)), "filename"), "filename")
    assert out.columns == ["filename", *gpsclean.OUTPUT] and len(gpsclean.OUTPUT) == 22
    r = out.orderBy("idx").first()
    assert r.time_utc == "2025-01-01T00:00:01+00:00" and r.time_local == "2024-12-31T14:00:01-10:00"
    sinks.cleaned_tracks(out, str(tmp_path / "out"), "filename")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_buoy(spark, tmp_path):
    write(tmp_path, "one.txt", BUOY)
    write(tmp_path, "two.txt", BUOY2)
    rows = readers.buoy(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.wave_height, r.wave_period, r.wave_direction, round(r.water_temp, 1)) for r in rows] == [(2.4000000953674316, 8.0, 51, 25.4), (None, 9.0, None, 25.5), (1.5, 7.0, 359, 20.5)]
    assert (rows[0].wave_height_unit, rows[0].wave_period_unit, rows[0].wave_direction_unit, rows[2].wave_period_unit) == ("meters", "seconds", "degrees", None)
    sinks.buoy_rows(readers.buoy(spark, str(tmp_path)), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["ts", "wave_height", "wave_period", "wave_direction", "water_temp"] and back.filter("ts = '2025-01-02 03:26:00Z'").count() == 1


def test_partitioned_exports(spark, tmp_path):
    rows = spark.createDataFrame([("kihei", "2024-01-01", 3.0, 1.0), ("kihei", "2024-01-01", 1.0, 2.0), ("hookipa", "2024-01-02", 2.0, 3.0)], "site string, day string, tsi double, wavg double")
    out = str(tmp_path / "wind")
    sinks.by_partition(rows, out, ["site", "day"], "tsi", gzip=True)
    files = list((tmp_path / "wind" / "site=kihei" / "day=2024-01-01").glob("*.gz"))
    assert len(files) == 1
    got = readers.site_day(spark, out, "tsi double, wavg double", "kihei", "2024-01-01")
    assert [r.tsi for r in got.collect()] == [1.0, 3.0]
    assert "PartitionFilters: [isnotnull(site" in got._jdf.queryExecution().toString()
    sinks.by_partition(rows.filter("site = 'kihei'").limit(1), out, ["site", "day"], "tsi")
    assert spark.read.option("header", True).csv(out).filter("site = 'hookipa'").count() == 1  # other partitions stay
    sinks.by_partition(rows.withColumn("run_id", F.lit("r1")), str(tmp_path / "runs"), ["run_id"], "tsi", files=3)
    got = readers.run_points(spark, str(tmp_path / "runs"), "site string, day string, tsi double, wavg double", "r1").collect()
    assert [r.tsi for r in got] == [1.0, 2.0, 3.0] and got[0].ts == datetime.datetime(1970, 1, 1, 0, 0, 1)


def test_drop_folder(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox, "Run 1.csv", HEAD + "1,2024-01-01,00:00:00,20.8,-156.6,5,90,0,1,2\n")
    seen = []
    for name in ("", "Run 2.csv", ""):
        if name:
            write(inbox, name, HEAD + "2,2024-01-01,00:00:00,20.8,-156.6,5,90,0,1,2\n")
        q = dropfolder.ingest(dropfolder.point_stream(spark, str(inbox), str(tmp_path / "archive")), str(tmp_path / "check"), lambda df, n: seen.extend(r.filename for r in df.collect()))
        q.awaitTermination()
    assert seen == ["Run 1", "Run 2"]


def test_one_file_though_a_join_went_by_the_same_key(spark, tmp_path):
    """A join by the key before the export is broadcast while it runs: rows of a run still end in one file."""
    rows = spark.range(40_000).select((F.col("id") % 20).alias("run_id"), F.floor(F.col("id") / 20).alias("seq"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.repartition(16).write.parquet(str(tmp_path / "in"))
    rows, was = spark.read.parquet(str(tmp_path / "in")), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        some = rows.groupBy("run_id").agg(F.min("seq").alias("first")).filter("first >= 0")
        sinks.by_partition(rows.repartition(16, "seq").join(some, "run_id", "left_semi"), str(tmp_path / "out"), ["run_id"], "seq", gzip=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(list((tmp_path / "out").glob("run_id=*"))) == len(list((tmp_path / "out").glob("run_id=*/*.gz"))) == 20


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("run_id"), F.lit(1.5).alias("tsi"))
    sinks.by_partition(rows, str(tmp_path), ["run_id"], "tsi")
    spark.sparkContext.setJobGroup("listing", "")
    back = readers.folders(spark, str(tmp_path), "tsi double, run_id long")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [spark.sparkContext.statusTracker().getStageInfo(i) for j in jobs for i in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    assert stages and all(s.numTasks <= 4 for s in stages) and spark.conf.get(readers.LISTING) == "10000"
    assert sorted(back.collect()) == [(1.5, i) for i in range(300)]


def test_files_of_a_batch_are_listed_by_few_tasks(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(40):
        write(inbox, f"Run {i}.csv", HEAD + f"{i},2024-01-01,00:00:00,20.8,-156.6,5,90,0,1,2\n")
    seen = []
    q = dropfolder.ingest_all(dropfolder.point_stream(spark, str(inbox)), str(tmp_path / "check"), lambda df, n: seen.extend(r.filename for r in df.collect()))
    found = spark.sparkContext.statusTracker()
    stages = [found.getStageInfo(i) for j in found.getJobIdsForGroup(q.runId) for i in found.getJobInfo(j).stageIds]
    assert sorted(seen) == sorted(f"Run {i}" for i in range(40)) and spark.conf.get(readers.LISTING) == "10000"
    assert stages and max(s.numTasks for s in stages) < 40


def test_named_files(spark, tmp_path):
    """One file for each value, also of values that hold commas."""
    rows = spark.createDataFrame([(k, f"{k} {i}", i) for k in ("a", "b, c", "d=e") for i in range(3)], "k string, line string, __order long")
    path = scratch.named_files(rows, str(tmp_path / "named"), "k", ["__order"], "the {}.txt", lines=True)
    assert {f.name: f.read_text().splitlines() for f in (tmp_path / "named").glob("*.txt")} == {f"the {n}.txt": [f"{k} {i}" for i in range(3)] for k, n in (("a", "a"), ("b, c", "b, c"), ("d=e", "d%3De"))}, path


def test_files_of_a_partition_in_order(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 2).alias("run_id"), F.pmod(F.col("id") * 7919, F.lit(4000)).cast("double").alias("tsi"), F.lit("x").alias("text"))
    sinks.by_partition(rows.filter("run_id = 0 OR tsi < 400"), str(tmp_path / "out"), ["run_id"], "tsi", files=4)
    for run, least in ((0, 5), (1, 1)):  # the large run gets more files than the small one
        files = sorted((tmp_path / "out" / f"run_id={run}").glob("part-*.csv"))
        times = [float(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
        assert len(files) >= least and times == sorted(times) and len(times) == (2000 if run == 0 else 200)


def test_few_tasks_write_many_partitions(spark, tmp_path):
    """The tasks that write do not grow in number as partitions do, each partition still gets several files, and they stand in order."""
    rows = spark.range(1800).select((F.col("id") % 300).alias("run_id"), F.pmod(F.col("id") * 7919, F.lit(1800)).cast("double").alias("tsi"))
    sinks.by_partition(rows, str(tmp_path / "out"), ["run_id"], "tsi", files=3)
    files = sorted((tmp_path / "out").glob("run_id=*/part-*.csv"))
    assert len({f.name.split("-")[1] for f in files}) <= 9
    for run in (0, 150, 299):
        own = [f for f in files if f.parent.name == f"run_id={run}"]
        times = [float(line) for f in own for line in f.read_text().splitlines()[1:]]
        assert len(own) >= 3 and times == sorted(times) and len(times) == 6


def test_run_points_lists_one_folder(spark, tmp_path):
    sinks.by_partition(spark.createDataFrame([("r1", 2.0), ("r1", 1.0), ("r2", 3.0)], "run_id string, tsi double"), str(tmp_path), ["run_id"], "tsi")
    (tmp_path / "other=1").mkdir()
    (tmp_path / "other=1" / "part.csv").write_text("tsi\n5.0\n")  # would be a conflict of partitions, were it looked at
    assert [(r.run_id, r.tsi) for r in readers.run_points(spark, str(tmp_path), "tsi double", "r1").collect()] == [("r1", 1.0), ("r1", 2.0)]


@pytest.mark.parametrize("when", ["before", "while", "after"])
def test_import_that_fails_and_runs_again(spark, tmp_path, when):
    """Whenever the first attempt at the points fails, the tables end up the same, and read files in the archive."""
    lists, inbox = tmp_path / "lists", tmp_path / "in"
    lists.mkdir(), inbox.mkdir()
    head = "Timestamp (from 1970),Date,Time,Max Speed (kmh),Avg Speed (kmh),Duration (sec),Distance (km),Name,Desc,Feeling,Equip 1,Equip 2\n"
    write(lists, "one.csv", head + "1704067200,2024-01-01,00:00:00,30,20,60,1,A,B,3,Board,Foil\n")
    write(inbox, "Run 1.csv", HEAD + "".join(f"{1704067200 + 5 * i},2024-01-01,00:00:00,{20.8 + 0.0003 * i},-156.6,6,90,120,1,2\n" for i in range(20)))
    coast = spark.createDataFrame([(1, 0, 20.8, -156.7, 20.9, -156.7)], "feature_id long, seg_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    store = dropfolder.Store(spark, str(tmp_path / "store"), dropfolder.RUNS)
    real, tries = dropfolder.import_points, []

    def flawed(*a):
        tries.append(1)
        if len(tries) == 1 and when == "before":
            raise RuntimeError("before")
        out = real(*a)
        return out.withColumn("speed", F.raise_error(F.lit("while")).cast("double")) if len(tries) == 1 and when == "while" else out

    def after(table, number):
        if table == "points" and when == "after" and len(tries) == 1:
            raise RuntimeError("after")

    take = lambda: dropfolder.import_drop(spark, str(lists), str(inbox), store, coast, str(tmp_path / "archive"), after)
    try:
        dropfolder.import_points = flawed
        with pytest.raises(StreamingQueryException):
            take()
        assert when == "after" or store.points() is None  # what was not written to the end does not count
        take()
        write(lists, "two.csv", head + "1704067200,2024-01-01,00:00:00,31,20,60,1,A,B,3,Board,Other\n1704153600,2024-01-02,00:00:00,30,20,60,1,A,B,3,Board,Foil\n")
        write(inbox, "Run 2.csv", HEAD + "1704153610,2024-01-02,00:00:00,20.8,-156.6,5,90,0,1,2\n")
        take()
    finally:
        dropfolder.import_points = real
    runs = {r.filename: (r.max_speed_kmh, r.foil, r.id) for r in store.runs().collect()}
    assert {k: v[:2] for k, v in runs.items()} == {"Waterspeed 2024-01-01 00.00.00": (31.0, "Other"), "Waterspeed 2024-01-02 00.00.00": (30.0, "Foil")}
    assert {(r.filename, r.run_id, r.n) for r in store.points().groupBy("filename", "run_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {("Run 1", runs["Waterspeed 2024-01-01 00.00.00"][2], 20), ("Run 2", runs["Waterspeed 2024-01-02 00.00.00"][2], 1)}


def test_import_measures_all_new_files_at_once(spark, tmp_path, monkeypatch):
    """Files come in by batches, but the coast is gone through once; nothing to take in is no error."""
    lists, inbox, calls = tmp_path / "lists", tmp_path / "in", []
    lists.mkdir(), inbox.mkdir()
    coast = spark.createDataFrame([(1, 0, 20.8, -156.7, 20.9, -156.7)], "feature_id long, seg_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    store = dropfolder.Store(spark, str(tmp_path / "store"), dropfolder.RUNS)
    real, stream = dropfolder.import_points, dropfolder.point_stream
    monkeypatch.setattr(dropfolder, "import_points", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(dropfolder, "point_stream", lambda spark, folder, archive=None: stream(spark, folder, archive, files_per_batch=1))
    dropfolder.import_drop(spark, str(lists), str(inbox), store, coast)
    assert calls == [] and store.points() is None
    head = "Timestamp (from 1970),Date,Time,Max Speed (kmh),Avg Speed (kmh),Duration (sec),Distance (km),Name,Desc,Feeling,Equip 1,Equip 2\n"
    write(lists, "one.csv", head + "".join(f"{1704067200 + 7200 * k},2024-01-01,00:00:00,30,20,60,1,A,B,3,Board,Foil\n" for k in range(3)))
    for k in range(3):
        write(inbox, f"Run {k}.csv", HEAD + f"{1704067200 + 7200 * k},2024-01-01,00:00:00,20.8,-156.6,6,90,120,1,2\n")
    dropfolder.import_drop(spark, str(lists), str(inbox), store, coast)
    assert calls == [1] and sorted(r.filename for r in store.points().collect()) == ["Run 0", "Run 1", "Run 2"]


def test_conditions_read_only_the_days_asked_for(spark, tmp_path):
    wind = spark.range(24 * 60).select(F.lit("kihei").alias("site"), (F.col("id") * 3600.0).alias("tsi"), F.lit(1.0).alias("wavg"), F.lit(2.0).alias("wgust"), F.lit(90.0).alias("wdir"), F.col("id").alias("event_id"), F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") / 24).cast("int")).alias("day"))
    wind.write.partitionBy("site", "day").parquet(str(tmp_path / "wind"))
    stored = spark.read.parquet(str(tmp_path / "wind"))
    spark.createDataFrame([(1, 10 * 86_400.0 + 5400, 7200.0, "Kihei"), (2, 20 * 86_400.0 - 1800, 3600.0, "Kihei"), (3, 100 * 86_400.0, 60.0, "Kihei"), (4, 5.0, 60.0, "Nowhere")], "run_id long, ts double, duration_sec double, region string").write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))

    def files(df):
        df.collect()
        plan, found = df._jdf.queryExecution().executedPlan(), []
        todo = [plan.executedPlan() if hasattr(plan, "executedPlan") else plan]
        text = df._jdf.queryExecution().toString()
        assert "dynamicpruning" in text
        while todo:
            p = todo.pop()
            if p.nodeName().startswith("Scan parquet") and p.metrics().contains("numFiles"):
                found.append(p.metrics().apply("numFiles").value())
            subs = [p.plan()] if "QueryStage" in p.nodeName() else []
            todo += subs + [p.children().apply(i) for i in range(p.children().size())]
        return found

    met = conditions.in_interval(runs, stored, F.col("ts"), F.col("ts") + F.col("duration_sec"), conditions.WIND_SITES)
    assert sorted((r.run_id, r.event_id) for r in met.collect()) == [(1, 242), (1, 243), (2, 480)]
    assert max(files(conditions.in_interval(runs, stored, F.col("ts"), F.col("ts") + F.col("duration_sec"), conditions.WIND_SITES))) <= 4  # of 60 days
    # The last reading before the third run is 40 days old.
    got = sorted((r.run_id, r.tsi, r.event_id) for r in conditions.slice_for_runs(runs, stored, conditions.WIND_SITES, same_day=False).collect())
    assert got == [(1, 10 * 86_400.0 + 5400, 241), (1, 871_200.0, 242), (1, 874_800.0, 243), (2, 20 * 86_400.0 - 1800, 479), (2, 1_728_000.0, 480), (3, 100 * 86_400.0, 24 * 60 - 1)]
    some = conditions.slice_for_runs(runs, stored, conditions.WIND_SITES, same_day=False, lookback_s=86_400)
    assert sorted((r.run_id, r.event_id) for r in some.collect()) == [(1, 241), (1, 242), (1, 243), (2, 479), (2, 480)]


def test_import_end_to_end(spark, tmp_path):
    body = "".join(f"{1704067200 + 5 * i},2024-01-01,00:00:00,{20.8 + 0.0003 * i},-156.6,{6 if i > 3 else 1},90,120,1,2\n" for i in range(60))
    write(tmp_path, "Waterspeed 2024-01-01 00.00.30.csv", HEAD + body)
    staged = readers.points(spark, str(tmp_path))
    runs = spark.createDataFrame([("r1", "x", "Downwind", 1704067230.0, None, None)], "id string, filename string, sport string, ts double, start_pos long, end_pos long")
    known = spark.createDataFrame([], "run_id string")
    coast = spark.createDataFrame([(1, 0, 20.8, -156.7, 20.9, -156.7)], "feature_id long, seg_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    beaches = spark.createDataFrame([(1, "A", "R", 20.8, -156.6), (2, "B", "R", 20.82, -156.6)], "beach_id long, beach string, region string, lat double, lon double")
    points = ingest.import_points(staged, runs, known, coast)
    assert points.count() == 60 and points.filter("nearest_land_lon != -156.7").count() == 0
    r = ingest.update_runs(runs, points, beaches).first()
    assert r.ts == 1704067200.0 and (r.start_pos, r.end_pos) == (1, 2) and r.paddle_up_count == 1 and r.max_distance > 10_000 and r.min_foiling_hr == 120


def texts(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_texts(spark):
    lit = lambda x: F.lit(x)
    assert texts(spark, *[text.seconds(lit(x)) for x in (3723, 60, 0, 59.7, 3600)]) == ["1h 2m 3s", "1m", "", "60s", "1h"]
    assert texts(spark, *[text.time_diff(lit(0.0), lit(x)) for x in (90061.0, 3661.0, 61.5, 5.0)]) == ["1d 1h", "1h 1m", "1m 1s", "0m 5s"]
    assert texts(spark, text.pace(lit(24.0)), text.pace(lit(0.0)), text.minutes(lit(2.05)), text.speed(lit(12.345)), text.heart_rate(lit(0)), text.heart_rate(lit(99.6))) == ["2:30 min/km", None, "2:02", "12.35 kph", "unknown bpm", "100 bpm"]
    assert texts(spark, text.distance(lit(999.4)), text.distance(lit(1500.0)), text.whole_or_unknown(lit(0)), text.whole_or_unknown(lit(4.6))) == ["999 m", "1.50 km", "?", "5"]
    assert texts(spark, text.wind(lit(12.0), lit(15.0), lit(40)), text.wind(lit(12.0), lit(15.0), lit(0)), text.wind(lit(0.0), lit(15.0), lit(1))) == ["12g15 knots @40°", "12g15 knots", "unknown"]
    assert texts(spark, *[text.foil_name(lit(x)) for x in ("A 725.0 cm2", "A 1.0 cm2 2.0 cm2", "", "B")]) == ["A", "A 2.0 cm2", "unknown foil", "B"]
    assert texts(spark, text.run_key(lit("file:/a/b%20c.csv.csv")), text.unit_name(lit("degT")), text.unit_name(lit("na")), text.comma(lit(1234567))) == ["b c.csv", "degrees", None, "1,234,567"]
    at = F.timestamp_seconds(lit(1704164645))
    assert texts(spark, text.date(at), text.time(at), text.timestamp(at), text.month_year(at)) == ["2024-01-02", "03:04:05", "2024-01-02 03:04:05", "Jan 2024"]


def test_numbers_are_rounded_by_their_exact_values(spark):
    values = [0.5, 1.5, 2.5, 140.5, 139.5, 0.125, 0.375, 2.675, 1.005, 12.345, 0.285, 1234567.125, 99.995, 0.004999999999999999, 8.0, 27.4999999999999]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.heart_rate(F.col("v")).alias("whole"), text.speed(F.col("v")).alias("two")).collect()
    assert [(r.whole, r.two) for r in got] == [(f"{r.v:.0f} bpm", f"{r.v:.2f} kph") for r in got]
    assert texts(spark, text.seconds(F.lit(30.5)), text.seconds(F.lit(29.5))) == ["31s", "30s"]
