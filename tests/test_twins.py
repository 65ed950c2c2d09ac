"""Window forms against plain loops on random tracks with ties, gaps and nulls."""

from __future__ import annotations

import math
import random
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import geo
from trackmill.operators import conditions, crashes, dashboard, gpsclean, grid, islands, matching, merge, nearest, pieces, segments, tracks

POINT = "run_id long, seq long, tsi double, lat double, lon double, speed double, hr int, hdop double"


def random_tracks(seed, n=12, longest=80):
    rng = random.Random(seed)
    rows = []
    for run in range(n):
        at, lat, lon, speed = 1.7e9 + run * 1000, 20.8, -156.6, 12.0
        for seq in range(rng.randint(1, longest)):
            at += rng.choice([0, 0.5, 1, 1, 2, 2, 4, 30])
            lat += rng.choice([0, 0, 0.00004, 0.0001]) * (1 if rng.random() < 0.95 else 30)
            speed = max(0.0, min(40.0, speed + rng.choice([-6, -1, 0, 1, 6, 25, -25])))
            rows.append((run, seq, at, lat, lon, rng.choice([speed, speed, 11.0, 15.0, None]), rng.choice([0, 100, 120, None]), rng.choice([1.0, 1.0, 5.0, 9.0, None])))
    return rows


def by_run(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def way(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def near(a, b, tol=1e-6):
    return a is b or (a is not None and b is not None and abs(a - b) <= tol)


def test_segments_debounce(spark):
    rows = random_tracks(1, 30)
    got = {(r.run_id, r.seq): (r.on_foil, r.segment) for r in segments.segments(spark.createDataFrame(rows, POINT)).collect()}
    for run, pts in by_run(rows).items():
        state = pending = since = None
        number = 0
        for p in pts:
            on = p[5] is not None and p[5] >= 11
            if state is None:
                state, number = on, 1
            elif on == state:
                pending = None
            else:
                if pending is None:
                    pending, since = on, p[2]
                if p[2] - since >= 5:
                    state, pending, number = on, None, number + 1
            assert got[run, p[1]] == (state, number), (run, p)


def test_fastest_and_means(spark):
    rows = random_tracks(2, 15)
    far = tracks.with_trailing_means(tracks.with_distance(spark.createDataFrame(rows, POINT)), metres=60)
    points = defaultdict(list)
    for r in far.collect():
        points[r.run_id].append(r)
    fast = {r.run_id: r for r in segments.fastest(far, metres=60).collect()}
    for run, pts in points.items():
        pts.sort(key=lambda r: r.seq)
        best = None
        for i, a in enumerate(pts):
            end = next((b for b in pts[i + 1 :] if b.distance - a.distance >= 60), None)
            if end and (best is None or end.tsi - a.tsi < best[0] - 1e-9):
                best = (end.tsi - a.tsi, a.tsi, end.tsi)
            behind = [b.speed for b in pts if a.distance - 60 - 1e-9 <= b.distance <= a.distance + 1e-9 and b.speed is not None]
            assert near(a.avg_speed_1k, sum(behind) / len(behind) if behind else None, 0.5)
            late = [b.speed for b in pts if a.tsi - 15 <= b.tsi <= a.tsi and b.speed is not None]
            assert near(a.avg_speed_15s, sum(late) / len(late) if late else None)
        assert (run in fast) == (best is not None)
        if best:
            assert near(fast[run].duration, best[0]) and near(fast[run].start_tsi, best[1])


def test_cleaning_stages(spark):
    rows = [(a, b, c, d, e, 0.0, None, h) for a, b, c, d, e, _, _, h in random_tracks(3, 25)]
    got = defaultdict(dict)
    for r in gpsclean.clean(spark.createDataFrame(rows, POINT)).collect():
        got[r.run_id][r.seq] = r
    for run, pts in by_run(rows).items():
        n, at, pos = len(pts), [p[2] for p in pts], [(p[3], p[4]) for p in pts]
        held, good = [], None
        for i, p in enumerate(pts):
            geom = False
            if 0 < i < n - 1:
                direct, via = way(pos[i - 1], pos[i + 1]), way(pos[i - 1], pos[i]) + way(pos[i], pos[i + 1])
                geom = direct > 0 and via > 5 and via > 2.5 * direct
            bad = p[7] is not None and p[7] > 5
            if good is None or not (geom or bad):
                good = pos[i]
            held.append(good)
            r = got[run][i]
            assert r.position_outlier == (geom or bad) and (r.lat_held, r.lon_held) == good
        v = []
        for i in range(n):
            j = next(j for j in range(n) if at[i] - at[j] <= 2)
            v.append(way(held[j], held[i]) / (at[i] - at[j]) * 3.6 if at[i] > at[j] else 0.0)
        h = []
        for i in range(n):
            local = [v[j] for j in range(n) if abs(at[j] - at[i]) <= 12]
            med = statistics.median(local)
            mad = statistics.median(abs(x - med) for x in local)
            hit = len(local) >= 3 and abs(v[i] - med) > 8 and abs(v[i] - med) / (1.4826 * max(mad, 3 / 1.4826)) > 4
            h.append(med if hit else v[i])
        a = []
        for i in range(n):
            out = h[i]
            if 0 < i < n - 1:
                x, y = at[i] - at[i - 1], at[i + 1] - at[i]
                if 0 < x <= 3 and 0 < y <= 3:
                    up, down = (h[i] - h[i - 1]) / x, (h[i + 1] - h[i]) / y
                    if abs(up) > 20 and abs(down) > 20 and (up > 0) != (down > 0):
                        out = h[i - 1] + (h[i + 1] - h[i - 1]) * x / (x + y)
            a.append(out)
        for i in range(n):
            pre, post = ([a[j] for j in range(n) if lo <= s * (at[j] - at[i]) <= hi] for s, lo, hi in ((-1, 3, 10), (1, 3, 10)))
            p, q = (statistics.median(pre), statistics.median(post)) if pre and post else (None, None)
            flat = (p + q) / 2 if p is not None and abs(p - q) < 8 and abs(a[i] - p) > 8 and abs(a[i] - q) > 8 else a[i]
            final = flat if flat <= 65 else (p + q) / 2 if p is not None else 65
            r = got[run][i]
            for name, want in (("speed_2s", v[i]), ("speed_hampel", h[i]), ("speed_accel", a[i]), ("speed_plateau", flat), ("speed_final", final)):
                assert near(r[name], want, 1e-4), (run, i, name)


def test_cap_alone(spark):
    rows = spark.createDataFrame([(70.0, 20.0, 30.0), (70.0, 20.0, None), (70.0, None, 30.0), (70.0, None, None), (65.0, None, None)], "speed_plateau double, pre_flank double, post_flank double")
    assert [r.speed_final for r in gpsclean.cap(rows).collect()] == [25.0, 20.0, 30.0, 65.0, 65.0]


def test_islands_break_at_nulls_and_thresholds(spark):
    speeds = [12, 12, None, 12, 11, 12, 12, 12]
    rows = [(1, i, i * 10.0, 20.0, -156.0, None if s is None else float(s), 0, 1.0) for i, s in enumerate(speeds)]
    found = islands.islands(tracks.with_distance(spark.createDataFrame(rows, POINT)))
    assert sorted((r.start_tsi, r.end_tsi) for r in found.collect()) == [(0, 10), (30, 30), (50, 70)]
    stats = islands.island_stats(found).first()
    assert stats.paddle_up_count == 1 and stats.longest_segment_start == 0 and stats.distance_to_first_paddle_up is None


def test_crash_needs_margins_and_a_fast_row_before(spark):
    rows = [(1, i, i * 10.0, 20.0, -156.0, 4.0 if i in (5, 40, 60) else 20.0, 0, 1.0) for i in range(80)]
    rows += [(2, 0, 0.0, 20.0, -156.0, 4.0, 0, 1.0)]
    got = crashes.crashes(spark.createDataFrame(rows, POINT), mean_over=10, now_below=5).collect()
    assert [r.seq for r in got] == [40]


def test_match_exactly_at_the_tolerance(spark):
    points = spark.createDataFrame([("a", 1000.0), ("a", 1500.0), ("b", 5000.0), ("c", 299.0)], "filename string, tsi double")
    runs = spark.createDataFrame([(1, 1299.9, "Downwind"), (2, 1300.0, "Downwind"), (3, 701.0, "Downwind"), (4, 5000.0, "Wing"), (5, -0.5, "Downwind")], "id int, ts double, sport string")
    matches = matching.match_runs(points, runs)
    assert sorted(map(tuple, matches.collect())) == [("a", 1), ("a", 3), ("c", 5)]
    try:
        matching.require_matched(points, matches)
        raise AssertionError("no error")
    except ValueError as e:
        assert "b" in str(e)


def test_new_files_with_null_names(spark):
    files = spark.createDataFrame([("a",), ("b",)], "filename string")
    runs = spark.createDataFrame([(1, "a"), (2, None)], "id long, filename string")
    assert [r[0] for r in matching.new_files(files, runs, spark.createDataFrame([(1,), (2,)], "run_id long")).collect()] == ["b"]


def test_similar_runs_of_one(spark):
    runs = spark.createDataFrame([(1, 10.0, 1, 2), (2, 20.0, 1, 3), (3, 30.0, 4, 2), (4, 40.0, 5, 6), (5, 15.0, 1, 2)], "run_id long, ts double, start_pos int, end_pos int")
    got = matching.similar_runs(runs, of=1).orderBy("rank").collect()
    assert [r.other for r in got] == [3, 2, 5]
    assert matching.similar_runs(runs, everything=True, of=1).count() == 4


def test_similar_runs_of_a_popular_beach(spark):
    """The newest of each run from the newest of its beaches: the same as all pairs, ranked."""
    rng = random.Random(7)
    runs = [(i, float(rng.randrange(50)), rng.randrange(3) if i % 3 else 0, rng.randrange(12)) for i in range(120)]
    got = defaultdict(list)
    for r in matching.similar_runs(spark.createDataFrame(runs, "run_id long, ts double, start_pos int, end_pos int"), top=7).collect():
        got[r.run_id].append((r["rank"], r.other))
    for i, _, s, e in runs:
        others = sorted((-ts, j) for j, ts, s2, e2 in runs if j != i and (s == s2 or e == e2))[:7]
        assert [o for _, o in sorted(got[i])] == [j for _, j in others]


def test_pieces_equal_whole_windows(spark):
    """Runs cut into dozens of pieces: empty pieces between, ties over borders, null speeds, null and one-row runs."""
    rows = [(r[0], *r[1:]) for r in random_tracks(11, 14, 200)] + [(None, 0, 1.7e9, 20.0, -156.0, 12.0, 1, 1.0), (None, 1, 1.7e9 + 70, 20.001, -156.0, None, 1, 1.0)]
    rows += [(77, k, 1.7e9 + 9000 * k, 20.0 + 0.01 * k, -156.0, 20.0 * (k % 3), 1, 1.0) for k in range(12)] + [(78, 0, 1.7e9, None, -156.0, 12.0, 1, 1.0), (78, 1, 1.7e9 + 20, 20.0, -156.0, 13.0, 1, 1.0)]
    points = spark.createDataFrame(rows, POINT)
    key = lambda r: (str(r.run_id), r.seq)
    whole = tracks.with_trailing_means(tracks.with_distance(points))
    dist = pieces.with_distance(points, piece_s=15)
    assert dist.columns == [*points.columns, "step_m", "distance"]
    cut = {key(r): r for r in pieces.with_trailing_means(tracks.with_distance(points), piece_s=15, piece_m=1000).collect()}
    own = {key(r): r for r in dist.collect()}
    for r in whole.collect():
        assert near(own[key(r)].distance, r.distance) and near(own[key(r)].step_m, r.step_m)
        assert near(cut[key(r)].avg_speed_15s, r.avg_speed_15s, 1e-9) and near(cut[key(r)].avg_speed_1k, r.avg_speed_1k, 1e-9)
    assert len(own) == len(cut) == len(rows)
    for limit in (11.0, 0.0):
        marks = [{key(r): (r.__getitem__("__fast"), r.island) for r in f.collect()} for f in (islands.with_islands(points, limit=limit), pieces.with_islands(points, limit=limit, piece_s=15))]
        assert marks[0] == marks[1]
    held = {key(r): r.held for r in pieces.with_last(points, F.when(F.col("speed") > 20, F.col("speed")), "held", piece_s=15).collect()}
    for run, pts in by_run(rows).items():
        last = None
        for p in sorted(pts, key=lambda p: (p[2], p[1])):
            last = p[5] if p[5] is not None and p[5] > 20 else last
            assert held[str(run), p[1]] == last
    found = [sorted(map(str, f.select("run_id", "seq", F.round("avg_speed", 9)).collect())) for f in (crashes.crashes(points, margin_s=20, mean_over=10), pieces.crashes(points, margin_s=20, mean_over=10, piece_s=15))]
    assert found[0] == found[1] and len(found[0]) > 3
    with pytest.raises(ValueError):
        pieces.with_trailing_means(points, piece_s=10)


def test_beaches_by_grid_equal_all_beaches(spark, monkeypatch):
    rng = random.Random(9)
    beaches = [(k, f"b{k}", "R", rng.choice([rng.uniform(20, 21), rng.uniform(-80, 80)]), rng.uniform(-179, 179) if k % 2 else -156 + rng.random()) for k in range(80)] + [(90, "twin", "R", 20.5, -155.5), (91, "twin", "R", 20.5, -155.5)]
    ends = [(i, w, rng.choice([rng.uniform(20, 21), rng.uniform(-85, 85)]), rng.choice([-156 + rng.random(), rng.uniform(-179, 179)])) for i in range(40) for w in ("first", "last")] + [(50, "first", 20.5, -155.5), (51, "first", None, 1.0)]
    by_run = {i: {w: (y, x) for j, w, y, x in ends if j == i} for i, *_ in ends}
    rows = spark.createDataFrame([(i, e["first"], e.get("last"), len(e)) for i, e in by_run.items()], "run_id long, first struct<lat:double,lon:double>, last struct<lat:double,lon:double>, n long")
    found = lambda: {r.run_id: (r.start_pos, r.end_pos) for r in matching.beaches_of(rows, spark.createDataFrame(beaches, "beach_id long, beach string, region string, lat double, lon double")).collect()}
    got = found()
    monkeypatch.setattr(matching, "FEW_BEACHES", 10)
    for part in (4096, 10):
        monkeypatch.setattr(grid.attach, "__defaults__", (False, grid.SIZE, "nearest", part))
        assert found() == got
    best = lambda y, x: None if y is None else min((math.dist((y, x), (b[3], b[4])), b[0]) for b in beaches)[1]
    for i, w, y, x in ends:
        assert got[i][w == "last"] == best(y, x), (i, w)


def test_one_point_run_has_a_start_only(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 20.81, -156.6, 1.0, 0, 1.0)], POINT)
    beaches = spark.createDataFrame([(1, "A", "R", 20.8, -156.6), (2, "B", "R", 20.82, -156.6), (3, "C", "R", 20.9, -156.6)], "beach_id long, beach string, region string, lat double, lon double")
    r = matching.end_beaches(points, beaches).first()
    assert r.start_pos in (1, 2) and r.end_pos is None


def test_write_back_modes_and_upsert(spark):
    runs = spark.createDataFrame([(1, 5, None), (2, None, 7), (3, 1, 1)], "id long, a int, b int")
    stats = spark.createDataFrame([(1, 50, 60), (2, 51, 61)], "id long, a int, b int")
    read = lambda mode: {r.id: (r.a, r.b) for r in merge.apply_stats(runs, stats, "id", mode).collect()}
    assert read("overwrite") == {1: (50, 60), 2: (51, 61), 3: (1, 1)}
    assert read("fill") == {1: (50, 60), 2: (51, 61), 3: (1, 1)}
    assert read("all") == {1: (50, 60), 2: (51, 61), 3: (None, None)}
    full = merge.apply_stats(spark.createDataFrame([(1, 5, 6)], "id long, a int, b int"), stats, "id", "fill").first()
    assert (full.a, full.b) == (5, 6)


def test_nearest_land_equals_product_form(spark):
    rng = random.Random(4)
    pts = [(i, 20 + rng.random(), -156 + rng.random()) for i in range(60)] + [(100 + i, rng.uniform(-60, 70), rng.uniform(-170, -20)) for i in range(20)] + [(200, 20.5, -155.5), (201, 20.5, -155.5)]
    segs = [(f, s, 20 + rng.random(), -156 + rng.random(), 20 + rng.random(), -156 + rng.random()) for f in range(5) for s in range(6)]
    segs += [(9, 0, 20.5, -155.5, None, None), (10, 0, 20.1, -155.1, 20.1, -155.1), (11, 0, 60.0, -100.0, 61.0, -40.0), (12, 0, -10.0, -90.0, 10.0, -80.0)]
    segs += [(13 + i, 0, 64.0 + i * 0.2, -150.0 + 9 * i, 65.0 + i * 0.2, -149.0 + 9 * i) for i in range(8)]
    points = spark.createDataFrame(pts, "run_id long, lat double, lon double")
    coast = spark.createDataFrame(segs, "feature_id long, seg_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    want = {}
    for i, y, x in pts:
        best = {}
        for f, _, y1, x1, y2, x2 in segs:
            dy, dx = (0, 0) if y2 is None else (y2 - y1, x2 - x1)
            t = 0 if dy == dx == 0 else min(1, max(0, ((y - y1) * dy + (x - x1) * dx) / (dy * dy + dx * dx)))
            p = (y1 + t * dy, x1 + t * dx)
            d = (y - p[0]) ** 2 + (x - p[1]) ** 2
            if f not in best or d < best[f][0]:
                best[f] = (d, p)
        want[i] = min((way((y, x), p), p) for _, p in best.values())[1]
    for size in (0.004, 0.02, 3.0):
        got = {r.run_id: (r.nearest_land_lat, r.nearest_land_lon) for r in nearest.nearest_land(points, coast, size).collect()}
        assert all(near(got[i][0], want[i][0], 1e-9) and near(got[i][1], want[i][1], 1e-9) for i in want)
    assert nearest.nearest_land(points, coast.limit(0)).filter("nearest_land_lat IS NOT NULL").count() == 0
    gaps = spark.createDataFrame([(1, None, -156.0)], "run_id long, lat double, lon double")
    assert nearest.nearest_land(gaps, coast).first().nearest_land_lat is None


def _coast(rng, lat, lon, n, features):
    out, y, x = [], float(lat), float(lon)
    for i in range(n):
        y2, x2 = y + 0.0006 * rng.uniform(0.3, 1), x + rng.uniform(-0.0003, 0.0003)
        out.append((i * features // n, i, y, x, y2, x2))
        y, x = y2, x2
    return out


def _product_form(points, segs):
    """Nearest land of each point: every segment, in the plane for a feature, on the sphere among features."""
    s, own = np.array([x[2:] for x in segs]), np.array([x[0] for x in segs])
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    dy, dx = s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
    square = dy * dy + dx * dx
    out = []
    for y, x in points:
        t = np.clip(((y - s[:, 0]) * dy + (x - s[:, 1]) * dx) / square, 0, 1)
        py, px = s[:, 0] + t * dy, s[:, 1] + t * dx
        d = (y - py) ** 2 + (x - px) ** 2
        best = [a + int(d[a:b].argmin()) for a, b in zip(starts, [*starts[1:], len(own)], strict=True)]
        out.append(min((way((y, x), (py[k], px[k])), own[k], py[k], px[k]) for k in best)[2:])
    return out


@pytest.mark.parametrize("case", ["greenwich", "equator", "meridian", "open sea", "pole"])
def test_nearest_land_where_grids_have_borders(spark, case):
    rng = random.Random(case)
    at = {
        "greenwich": ([(51.5 + rng.uniform(0, 4), -0.01 + rng.uniform(-0.01, 0.005)) for _ in range(400)], _coast(rng, 51.4, 0.01, 12_000, 9)),
        "equator": ([(rng.uniform(-1, 1), 100 + rng.uniform(-0.02, 0.02)) for _ in range(400)], _coast(rng, -3, 100.0, 12_000, 9)),
        "meridian": ([(20 + rng.uniform(0, 0.3), rng.choice([179.98, -179.99]) + rng.uniform(-0.01, 0.01)) for _ in range(60)], _coast(rng, 19.9, 179.99, 4000, 300) + [(500 + f, *r) for f, *r in _coast(rng, 19.9, -179.97, 1500, 40)]),
        "open sea": ([(20 + rng.uniform(0, 3), -156.0) for _ in range(100)], _coast(rng, 19, -154, 8000, 5)),
        "pole": ([(89.95, 10.0), (-89.9, 100.0), (89.5, -170.0), (0.0, 0.0), (90.0, 0.0)], [(0, 0, 89.9, -170.0, 89.95, -160.0), (1, 0, 80.0, 10.0, 81.0, 11.0), (2, 1, -70.0, 0.0, -71.0, 50.0)]),
    }[case]
    points = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(at[0])] + [(-1, None, 1.0), (-2, 1.0, None), (-3, float("nan"), 1.0), (-4, 95.0, 1.0)], "run_id long, lat double, lon double")
    coast = spark.createDataFrame(at[1], "feature_id long, seg_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    for few in (0, 1 << 20) if case in ("pole", "meridian") else (0,):
        cells = grid.table(points.filter("run_id >= 0"), coast, "feature_id", True, few=few).select(F.size("parts").alias("n"))
        got = {r.run_id: (r.nearest_land_lat, r.nearest_land_lon) for r in nearest.nearest_land(points, coast, few=few).collect()}
        assert all(got.pop(i) == (None, None) for i in (-1, -2, -3, -4))
        for i, want in enumerate(_product_form(*at)):
            assert near(got[i][0], want[0], 1e-7) and near(got[i][1], want[1], 1e-7), (i, at[0][i])
        if case in ("greenwich", "equator"):  # of 12,000; about 1.5 km of coast on either side lie as near as the cell is wide
            assert cells.agg(F.max("n")).first()[0] <= 120


def test_dense_long_segments_leave_few_to_choose_from(spark):
    """Thousands of segments that cross a whole area: cells are divided until few are left, and nothing nearer is lost."""
    rng = random.Random(5)
    segs = [(i // 240, i, 20 + 0.3 * rng.random(), -156 + 0.1 * rng.random(), 20 + 0.3 * rng.random(), -156 + 0.1 * rng.random()) for i in range(6000)]
    at = [(20.1 + 0.00005 * k, -155.95 + 0.00008 * k) for k in range(200)] + [(20.15 + 0.1 * rng.random(), -155.96 + 0.05 * rng.random()) for _ in range(40)] + [(21.0, -155.0)]
    points = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(at)], "run_id long, lat double, lon double")
    coast = spark.createDataFrame(segs, "feature_id long, seg_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    assert grid.table(points, coast, "feature_id", True).agg(F.avg(F.size("parts"))).first()[0] < grid.MANY
    got = {r.run_id: (r.nearest_land_lat, r.nearest_land_lon) for r in nearest.nearest_land(points, coast).collect()}
    for i, want in enumerate(_product_form(at, segs)):
        assert near(got[i][0], want[0], 1e-7) and near(got[i][1], want[1], 1e-7), at[i]


def test_conditions_edges(spark):
    runs = spark.createDataFrame([(1, 7200.0, 600.0, "Kihei"), (2, 7200.0, 600.0, "Kihei"), (3, 90000.0, 60.0, "Kihei"), (4, 7200.0, 600.0, None)], "run_id long, ts double, duration_sec double, region string")
    wind = spark.createDataFrame([("kihei", t, float(i), float(i), d, i) for i, (t, d) in enumerate([(5400.0, 10.0), (7000.0, 350.0), (7800.0, 0.0), (7801.0, 90.0), (100.0, 5.0)])], "site string, tsi double, wavg double, wgust double, wdir double, event_id int")
    stats = {r.run_id: r for r in conditions.wind_by_run(runs, wind).collect()}
    assert set(stats) == {1, 2, 3} and stats[1].avg_wavg == 1.0 and stats[1].avg_wdir == 0 and stats[3].avg_wavg is None
    got = sorted((r.run_id, r.tsi, r.event_id) for r in conditions.slice_for_runs(runs, wind, conditions.WIND_SITES).collect())
    assert got == [(1, 7200.0, 1), (1, 7800.0, 2), (2, 7200.0, 1), (2, 7800.0, 2)]
    # Three hours further west the day began at 03:00, so the reading before is of another day; the run's end is on the same.
    west = spark.createDataFrame([(1, 10900.0, 600.0, "Kihei"), (2, 90000.0, 30000.0, "Kihei")], "run_id long, ts double, duration_sec double, region string")
    wind = spark.createDataFrame([("kihei", t, 1.0, 1.0, 1.0, i) for i, t in enumerate([10700.0, 11000.0, 86000.0, 97000.0, 97300.0])], "site string, tsi double, wavg double, wgust double, wdir double, event_id int")
    got = sorted((r.run_id, r.tsi, r.event_id) for r in conditions.slice_for_runs(west, wind, conditions.WIND_SITES, zone="Etc/GMT+3").collect())
    assert got == [(1, 10900.0, 1), (2, 90000.0, 2), (2, 97000.0, 3)]


def test_wind_rose_keeps_odd_bins(spark):
    rows = spark.createDataFrame([(-10.0, 5.0, None), (365.0, None, 16.0), (5.0, -1.0, None), (None, 5.0, None), (5.0, None, None)], "wdir double, wavg double, wgust double")
    got = sorted((r.sector, r.label, r.n) for r in conditions.wind_rose(rows).collect())
    assert got == [(0, "15–20", 1), (0, "30+", 1), (35, "0–15", 1)]


def test_speed_classes_and_scaling(spark):
    rows = [(1, i, float(i), 20.0, -156.0, float(s), 0, 1.0) for i, s in enumerate([5, 12, 13, 14, 15, 16, 17, 18])] + [(2, 0, 0.0, 20.0, -156.0, 20.0, 0, 1.0), (2, 1, 1.0, 20.0, -156.0, None, 0, 1.0)]
    df = spark.createDataFrame(rows, POINT)
    got = {(r.run_id, r.seq): r.speed_class for r in segments.speed_classes(df).collect()}
    assert [got[1, i] for i in range(8)] == [0, 1, 2, 3, 4, 5, 6, 6] and got[2, 1] == 0
    scaled = {(r.run_id, r.seq): (r.shade, r.scaled) for r in segments.scaled_speed(df).collect()}
    assert scaled[2, 0] == ("on", 0.5) and scaled[2, 1] == ("unknown", None) and scaled[1, 0] == ("off", None) and scaled[1, 7] == ("on", 1.0)


def test_hexagons_are_nearest(spark):
    rng = random.Random(6)
    pts = [(rng.uniform(-100, 100), rng.uniform(-100, 100)) for _ in range(300)]
    q, r = geo.hex_cell(F.col("x"), F.col("y"), 7.0)
    for row in spark.createDataFrame(pts, "x double, y double").select("x", "y", q.alias("q"), r.alias("r")).collect():
        centre = lambda a, b: (7 * math.sqrt(3) * (a + b / 2), 7 * 1.5 * b)
        far = lambda a, b: math.dist((row.x, row.y), centre(a, b))
        assert far(row.q, row.r) <= min(far(row.q + i, row.r + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) + 1e-9


def test_dashboard_rules(spark):
    runs = spark.createDataFrame([(1, 1704067200.0, 1000.0, 10.0, 980.0, 1000.0, 500.0, "Foil 725.0 cm2 x 1.0 cm2", 100), (2, 1704672000.0, 0.0, 0.0, 1.0, 0.0, None, None, 0)],
                                 "run_id long, ts double, duration_sec double, distance_km double, longest_segment_distance double, distance_on_foil double, duration_on_foil double, foil string, min_foiling_hr int")
    got = {r.run_id: r for r in dashboard.enrich(runs).collect()}
    assert got[1].dry and not got[2].dry and got[1].foil == "Foil x 1.0 cm2" and got[2].foil == "unknown foil"
    assert str(got[1].week) == "2023-12-31" and str(got[1].month) == "2024-01-01" and got[2].pct_time_on_foil is None
    recent = dashboard.recent(runs, 14, as_of=F.timestamp_seconds(F.lit(1704067200 + 14 * 86400)))
    assert [r.run_id for r in recent.collect()] == [2]
