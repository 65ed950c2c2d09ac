"""DuckDB SQL for each registered query, over the views of fixtures.py."""

from __future__ import annotations

from .fixtures import duck


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_W = "(PARTITION BY run_id ORDER BY tsi, seq)"
_HR = "nullif(hr, 0)"
CTES = f"""{duck()},
steps AS (SELECT *, coalesce({hav('lag(lat) OVER ' + _W, 'lag(lon) OVER ' + _W, 'lat', 'lon')}, 0) AS step_m FROM track_points),
dist AS (SELECT *, sum(step_m) OVER (PARTITION BY run_id ORDER BY tsi, seq ROWS UNBOUNDED PRECEDING) AS distance, CAST(round_even(tsi * 1000000, 0) AS BIGINT) AS us FROM steps),
means AS (SELECT *, avg(speed) OVER (PARTITION BY run_id ORDER BY us RANGE BETWEEN 15000000 PRECEDING AND CURRENT ROW) AS avg_speed_15s,
  avg(speed) OVER (PARTITION BY run_id ORDER BY distance RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS avg_speed_1k FROM dist),
marked AS (SELECT *, speed > 11 AS fast, CASE WHEN speed > 11 AND NOT coalesce(lag(speed > 11) OVER {_W}, false) THEN 1 ELSE 0 END AS is_start FROM dist),
grouped AS (SELECT *, sum(is_start) OVER {_W} AS island FROM marked),
islands AS (SELECT run_id, CAST(island AS BIGINT) AS island, min(tsi) AS start_tsi, max(tsi) AS end_tsi, min(distance) AS start_distance, max(distance) - min(distance) AS distance, max(tsi) - min(tsi) AS duration FROM grouped WHERE fast GROUP BY ALL),
longest AS (SELECT run_id, distance AS longest_segment_distance, start_tsi AS longest_segment_start, end_tsi AS longest_segment_end FROM islands QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY distance DESC, start_tsi) = 1),
paddle AS (SELECT run_id, count(*) AS paddle_up_count FROM islands WHERE duration >= 15 GROUP BY run_id),
firsts AS (SELECT run_id, arg_min(start_distance, start_tsi) AS distance_to_first_paddle_up FROM islands WHERE duration >= 60 GROUP BY run_id),
rolled AS (SELECT run_id, min(tsi) AS ts, max(speed) AS max_speed_kmh, avg(speed) AS avg_speed_kmh, max(tsi) - min(tsi) AS duration_sec, max(distance) / 1000 AS distance_km FROM dist GROUP BY run_id),
hearts AS (SELECT run_id, min({_HR}) AS min_foiling_hr, avg({_HR}) AS avg_foiling_hr FROM track_points WHERE speed > 15 GROUP BY run_id),
foil AS (SELECT run_id, sum(t) FILTER (WHERE speed > 11) AS duration_on_foil, sum(w) FILTER (WHERE speed > 11) AS distance_on_foil FROM
  (SELECT run_id, speed, lead(tsi) OVER {_W} - tsi AS t, distance - lag(distance) OVER {_W} AS w FROM dist) x GROUP BY run_id),
best1k AS (SELECT run_id, max(avg_speed_1k) AS max_speed_1k FROM means GROUP BY run_id),
near_flat AS (SELECT p.run_id, p.seq, p.lat, p.lon, s.feature_id, s.seg_id, s.lat1 + q.t * coalesce(s.lat2 - s.lat1, 0) AS y, s.lon1 + q.t * coalesce(s.lon2 - s.lon1, 0) AS x FROM track_points p CROSS JOIN coast_segments s,
  LATERAL (SELECT CASE WHEN coalesce(pow(s.lat2 - s.lat1, 2) + pow(s.lon2 - s.lon1, 2), 0) > 0 THEN least(greatest(((p.lat - s.lat1) * (s.lat2 - s.lat1) + (p.lon - s.lon1) * (s.lon2 - s.lon1)) / (pow(s.lat2 - s.lat1, 2) + pow(s.lon2 - s.lon1, 2)), 0), 1) ELSE 0 END AS t) q),
near_feature AS (SELECT run_id, seq, lat, lon, feature_id, arg_min(struct_pack(y := y, x := x), pow(lat - y, 2) + pow(lon - x, 2)) AS b FROM near_flat GROUP BY ALL),
land AS (SELECT run_id, seq, lat, lon, arg_min(b.y, d) AS nearest_land_lat, arg_min(b.x, d) AS nearest_land_lon, min(d) AS distance_to_land FROM
  (SELECT *, {hav('lat', 'lon', 'b.y', 'b.x')} AS d FROM near_feature) f GROUP BY ALL),
ends AS (SELECT run_id, 'first' AS which, lat, lon FROM track_points QUALIFY row_number() OVER {_W} = 1 UNION ALL
  SELECT run_id, 'last', lat, lon FROM track_points QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY tsi DESC, seq DESC) = 1 AND count(*) OVER (PARTITION BY run_id) > 1),
end_near AS (SELECT e.run_id, e.which, arg_min(b.beach_id, sqrt(pow(b.lat - e.lat, 2) + pow(b.lon - e.lon, 2)) * 1e6 + b.beach_id * 1e-9) AS beach_id FROM ends e CROSS JOIN beaches b GROUP BY ALL),
run_beaches AS (SELECT run_id, max(beach_id) FILTER (WHERE which = 'first') AS start_pos, max(beach_id) FILTER (WHERE which = 'last') AS end_pos FROM end_near GROUP BY run_id),
resolved AS (SELECT r.*, b.start_pos, b.end_pos, s.beach AS start_beach, s.region, e.beach AS end_beach FROM run_list r JOIN run_beaches b USING (run_id) JOIN beaches s ON s.beach_id = b.start_pos JOIN beaches e ON e.beach_id = b.end_pos),
regions AS (SELECT run_id, ts, duration_sec, CASE run_id % 3 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' ELSE 'ASIA' END AS region FROM run_list),
wind_met AS (SELECT r.run_id, w.* FROM regions r JOIN wind w ON w.site = CASE r.region WHEN 'AFRICA' THEN 'kihei' WHEN 'AMERICA' THEN 'hookipa' END AND w.tsi >= r.ts - 1800 AND w.tsi <= r.ts + r.duration_sec),
wind_stats AS (SELECT run_id, avg(wavg) AS avg_wavg, max(wavg) AS max_wavg, avg(wgust) AS avg_wgust, max(wgust) AS max_wgust,
  CASE WHEN avg(sin(radians(wdir))) = 0 AND avg(cos(radians(wdir))) = 0 THEN NULL ELSE CAST(round_even(round(degrees(atan2(avg(sin(radians(wdir))), avg(cos(radians(wdir))))) + 360, 9), 0) AS INT) % 360 END AS avg_wdir FROM wind_met GROUP BY run_id),
crashed AS (SELECT * FROM (SELECT *, avg(speed) OVER (PARTITION BY run_id ORDER BY us RANGE BETWEEN 15000000 PRECEDING AND CURRENT ROW) AS avg_speed, lag(speed) OVER {_W} AS prev, min(tsi) OVER (PARTITION BY run_id) AS lo, max(tsi) OVER (PARTITION BY run_id) AS hi FROM dist) x
  WHERE avg_speed > 15 AND speed < 5 AND coalesce(prev, 0) >= 5 AND tsi > lo + 300 AND tsi < hi - 300),
seg_raw AS (SELECT *, coalesce(speed >= 11, false) AS raw, row_number() OVER {_W} AS rn FROM dist),
seg_turn AS (SELECT *, CASE WHEN lag(raw) OVER {_W} = raw THEN 0 ELSE 1 END AS turn FROM seg_raw),
seg_isl AS (SELECT *, sum(turn) OVER {_W} AS isl FROM seg_turn),
seg_sure AS (SELECT *, CASE WHEN rn = 1 OR tsi - min(tsi) OVER (PARTITION BY run_id, isl) >= 5 THEN raw END AS sure FROM seg_isl),
seg_state AS (SELECT *, last_value(sure IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY tsi, seq ROWS UNBOUNDED PRECEDING) AS on_foil FROM seg_sure),
seg_flip AS (SELECT *, CASE WHEN lag(on_foil) OVER {_W} = on_foil THEN 0 ELSE 1 END AS flip FROM seg_state),
segs AS (SELECT *, CAST(sum(flip) OVER {_W} AS BIGINT) AS segment FROM seg_flip),
split AS (SELECT run_id, CAST(floor(distance / 1000) + 1 AS BIGINT) AS split, min(speed) AS min_speed, avg(speed) AS avg_speed, max(speed) AS max_speed, min({_HR}) AS min_hr, avg({_HR}) AS avg_hr, max({_HR}) AS max_hr FROM dist GROUP BY ALL),
ahead AS (SELECT a.run_id, a.tsi, a.seq, a.lat, a.lon, a.distance, b.tsi AS e_tsi, b.lat AS e_lat, b.lon AS e_lon, b.distance AS e_distance FROM dist a ASOF JOIN dist b ON a.run_id = b.run_id AND a.distance + 1000 <= b.distance),
fastest AS (SELECT * FROM ahead QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY e_tsi - tsi, tsi, seq) = 1),
c_flag AS (SELECT *, lag(lat) OVER {_W} AS pa, lag(lon) OVER {_W} AS po, lead(lat) OVER {_W} AS na, lead(lon) OVER {_W} AS no, row_number() OVER {_W} AS rn FROM track_points),
c_way AS (SELECT *, {hav('pa', 'po', 'na', 'no')} AS direct, {hav('pa', 'po', 'lat', 'lon')} + {hav('lat', 'lon', 'na', 'no')} AS via FROM c_flag),
c_out AS (SELECT *, coalesce(direct > 0 AND via > 5 AND via > direct * 2.5, false) AS geo, coalesce(hdop > 5, false) AS bad FROM c_way),
held AS (SELECT *, last_value(CASE WHEN rn = 1 OR NOT (geo OR bad) THEN lat END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY tsi, seq ROWS UNBOUNDED PRECEDING) AS lat_held,
  last_value(CASE WHEN rn = 1 OR NOT (geo OR bad) THEN lon END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY tsi, seq ROWS UNBOUNDED PRECEDING) AS lon_held FROM c_out),
c_start AS (SELECT *, CAST(round_even(tsi * 1000000, 0) AS BIGINT) AS us, first_value(tsi) OVER f AS t0, first_value(lat_held) OVER f AS lat0, first_value(lon_held) OVER f AS lon0 FROM held WINDOW f AS (PARTITION BY run_id ORDER BY tsi RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)),
c_speed AS (SELECT *, coalesce({hav('lat0', 'lon0', 'lat_held', 'lon_held')} / nullif(tsi - t0, 0) * 3.6, 0) AS speed_2s FROM c_start),
c_med AS (SELECT *, median(speed_2s) OVER f AS med, count(*) OVER f AS n FROM c_speed WINDOW f AS (PARTITION BY run_id ORDER BY us RANGE BETWEEN 12000000 PRECEDING AND 12000000 FOLLOWING)),
c_mad AS (SELECT a.run_id, a.seq, median(abs(b.speed_2s - a.med)) AS mad FROM c_med a JOIN c_speed b ON a.run_id = b.run_id AND b.us BETWEEN a.us - 12000000 AND a.us + 12000000 GROUP BY ALL),
c_hampel AS (SELECT c.*, mad, c.n >= 3 AND abs(speed_2s - med) / (greatest(mad, 3 / 1.4826) * 1.4826) > 4 AND abs(speed_2s - med) > 8 AS hampel_outlier, CASE WHEN c.n >= 3 AND abs(speed_2s - med) / (greatest(mad, 3 / 1.4826) * 1.4826) > 4 AND abs(speed_2s - med) > 8 THEN med ELSE speed_2s END AS speed_hampel FROM c_med c JOIN c_mad USING (run_id, seq)),
c_gap AS (SELECT *, lag(speed_hampel) OVER {_W} AS p, lead(speed_hampel) OVER {_W} AS nx, tsi - lag(tsi) OVER {_W} AS din, lead(tsi) OVER {_W} - tsi AS dout FROM c_hampel),
c_hit AS (SELECT *, coalesce(din > 0 AND dout > 0 AND din <= 3 AND dout <= 3 AND abs((speed_hampel - p) / nullif(din, 0)) > 20 AND abs((nx - speed_hampel) / nullif(dout, 0)) > 20 AND ((speed_hampel - p) > 0) <> ((nx - speed_hampel) > 0), false) AS accel_outlier FROM c_gap),
c_accel AS (SELECT *, CASE WHEN accel_outlier THEN p + (nx - p) * din / nullif(din + dout, 0) ELSE speed_hampel END AS speed_accel FROM c_hit),
c_flank AS (SELECT *, median(speed_accel) OVER (PARTITION BY run_id ORDER BY us RANGE BETWEEN 10000000 PRECEDING AND 3000000 PRECEDING) AS pre0, median(speed_accel) OVER (PARTITION BY run_id ORDER BY us RANGE BETWEEN 3000000 FOLLOWING AND 10000000 FOLLOWING) AS post0 FROM c_accel),
c_both AS (SELECT *, CASE WHEN post0 IS NOT NULL THEN pre0 END AS pre, CASE WHEN pre0 IS NOT NULL THEN post0 END AS post FROM c_flank),
c_plateau AS (SELECT *, coalesce(abs(pre - post) < 8 AND abs(speed_accel - pre) > 8 AND abs(speed_accel - post) > 8, false) AS plateau_outlier, CASE WHEN coalesce(abs(pre - post) < 8 AND abs(speed_accel - pre) > 8 AND abs(speed_accel - post) > 8, false) THEN (pre + post) / 2 ELSE speed_accel END AS speed_plateau FROM c_both),
c_final AS (SELECT *, speed_plateau > 65 AS sanity_capped, CASE WHEN speed_plateau > 65 THEN coalesce((pre + post) / 2, pre, post, 65.0) ELSE speed_plateau END AS speed_final FROM c_plateau),
c_way2 AS (SELECT *, coalesce({hav('lag(lat_held) OVER ' + _W, 'lag(lon_held) OVER ' + _W, 'lat_held', 'lon_held')}, 0) AS hstep FROM c_final),
cleaned AS (SELECT *, sum(hstep) OVER (PARTITION BY run_id ORDER BY tsi, seq ROWS UNBOUNDED PRECEDING) AS distance FROM c_way2),
info AS (SELECT r.run_id, r.ts, r.duration_sec, r.distance_km, r.max_speed_kmh, l.longest_segment_distance, p.paddle_up_count, f.duration_on_foil, f.distance_on_foil, h.min_foiling_hr, h.avg_foiling_hr, k.max_speed_1k, s.start_pos, s.end_pos, s.start_beach, s.end_beach, s.region,
  CAST(date_trunc('month', make_timestamp(CAST(r.ts * 1000000 AS BIGINT))) AS DATE) AS month, CAST(make_timestamp(CAST(r.ts * 1000000 AS BIGINT)) AS DATE) - CAST(dayofweek(make_timestamp(CAST(r.ts * 1000000 AS BIGINT))) AS INT) AS week,
  coalesce(l.longest_segment_distance / nullif(f.distance_on_foil, 0) > 0.97, false) AS dry
  FROM rolled r LEFT JOIN longest l USING (run_id) LEFT JOIN paddle p USING (run_id) LEFT JOIN foil f USING (run_id) LEFT JOIN hearts h USING (run_id) LEFT JOIN best1k k USING (run_id) JOIN resolved s USING (run_id))
"""


def R(*columns: str) -> str:
    """Columns rounded to 6 decimals under their own names."""
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c.split('.')[-1]}" for c in columns)


def N(*columns: str) -> str:
    """As R(), but nudged, so that means that stand exactly between two roundings fall alike in both engines."""
    return ", ".join(f"round({c} + 1e-9, 6) AS {c.split('.')[-1]}" for c in columns)


def slice_sql(table: str, sites: str, columns: str, shift: int = 0) -> str:
    """shift: seconds by which the day begins later than in UTC."""
    return f"""SELECT run_id, event_id, round(CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY tsi, event_id) = 1 THEN ts ELSE tsi END, 6) AS tsi, {columns} FROM
      (SELECT r.run_id, r.ts, w.*, row_number() OVER (PARTITION BY r.run_id, w.tsi < r.ts ORDER BY w.tsi DESC, w.event_id DESC) AS k FROM regions r JOIN {table} w ON w.site = {sites}
       AND w.tsi >= floor((r.ts - {shift}) / 86400) * 86400 + {shift} AND w.tsi <= least(r.ts + r.duration_sec, floor((r.ts - {shift}) / 86400) * 86400 + {shift} + 86400 - 0.000001)) x WHERE tsi >= ts OR k = 1"""


_STATS = "max_speed_kmh,avg_speed_kmh,duration_sec,distance_km,avg_foiling_hr,max_speed_1k,duration_on_foil,distance_on_foil,longest_segment_distance,longest_segment_start,longest_segment_end,distance_to_first_paddle_up".split(",")
_BREAKS = [0, 15, 20, 25, 30]
_BIN = "CASE WHEN wavg IS NULL THEN NULL " + " ".join(f"WHEN wavg >= {a} AND wavg < {b} THEN {i}" for i, (a, b) in enumerate(zip(_BREAKS, _BREAKS[1:], strict=False))) + " ELSE 4 END"
_LABEL = "CASE bin " + " ".join(f"WHEN {i} THEN '{a}–{b}'" for i, (a, b) in enumerate(zip(_BREAKS, _BREAKS[1:], strict=False))) + " ELSE '30+' END"
_COMPASS = "list_extract(['N','E','S','W'], CAST(floor(sector * 10 / 90.0 + 0.5) AS INT) % 4 + 1)"

_POINTS = (["N", "E", "S", "W"], ["N", "NE", "E", "SE", "S", "SW", "W", "NW"], "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split())

_US = "CAST(round_even(tsi * 1000000, 0) AS BIGINT)"
_WEEKS = "(SELECT * REPLACE (ts + run_id * 400000 AS ts, CAST(make_timestamp(CAST((ts + run_id * 400000) * 1000000 AS BIGINT)) AS DATE) - CAST(dayofweek(make_timestamp(CAST((ts + run_id * 400000) * 1000000 AS BIGINT))) AS INT) AS week) FROM info)"
_ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 > 0 THEN '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') ELSE '' END"
_BUOY = """SELECT strftime(make_timestamp(CAST(floor(tsi / 60) * 60 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_id % 10 <> 0 THEN round(floor(wave_height * 10) / 10, 1) END AS wave_height, round(wave_period, 1) AS wave_period,
      round(floor(water_temp * 10) / 10, 1) AS water_temp, CAST(wave_direction AS INT) AS wave_direction FROM swell"""
_RECENT = 1704067200 + 2 * 86400

BODIES = {
    "run_stats": f"SELECT r.run_id, r.ts, {R(*['r.' + c for c in _STATS[:4]])}, h.min_foiling_hr, {R('h.avg_foiling_hr')}, {N('k.max_speed_1k')}, {R('f.duration_on_foil', 'f.distance_on_foil', *['l.' + c for c in _STATS[8:11]])}, p.paddle_up_count, {R('d.distance_to_first_paddle_up')} FROM rolled r LEFT JOIN hearts h USING (run_id) LEFT JOIN best1k k USING (run_id) LEFT JOIN foil f USING (run_id) LEFT JOIN longest l USING (run_id) LEFT JOIN paddle p USING (run_id) LEFT JOIN firsts d USING (run_id)",
    "distance_running": f"SELECT run_id, seq, {R('step_m', 'distance')} FROM dist",
    "trailing_mean_15s": f"SELECT run_id, seq, {N('avg_speed_15s')} FROM means",
    "trailing_mean_1k": f"SELECT run_id, seq, {N('avg_speed_1k')} FROM means",
    "islands": f"SELECT run_id, island, {R('start_tsi', 'end_tsi', 'start_distance', 'distance', 'duration')} FROM islands",
    "islands_longest": f"SELECT run_id, {R('longest_segment_distance', 'longest_segment_start', 'longest_segment_end')} FROM longest",
    "paddle_ups": "SELECT run_id, paddle_up_count FROM paddle",
    "first_paddle_up": f"SELECT run_id, {R('distance_to_first_paddle_up')} FROM firsts",
    "run_rollup": f"SELECT run_id, date, time, {R('ts', 'max_speed_kmh', 'avg_speed_kmh', 'duration_sec', 'distance_km')} FROM rolled JOIN (SELECT run_id, min(strftime(make_timestamp(us), '%Y-%m-%d')) AS date, min(strftime(make_timestamp(us), '%H:%M:%S')) AS time FROM dist GROUP BY run_id) d USING (run_id)",
    "heart_rates": f"SELECT run_id, min_foiling_hr, {R('avg_foiling_hr')} FROM hearts",
    "max_speed_1k": f"SELECT run_id, {N('max_speed_1k')} FROM best1k",
    "foil_totals": f"SELECT run_id, {R('duration_on_foil', 'distance_on_foil')} FROM foil",
    "speed_and_heart": f"SELECT run_id, round(avg(speed) FILTER (WHERE speed > 11), 6) AS avg_foiling_speed, round(avg({_HR}), 6) AS avg_hr, max({_HR}) AS max_hr FROM track_points GROUP BY run_id",
    "heart_rate_missing": f"SELECT run_id, seq, {_HR} AS hr FROM track_points",
    "epoch_timestamp": "SELECT run_id, seq, strftime(make_timestamp(CAST(round_even(tsi * 1000000, 0) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM track_points",
    "normalise_points": f"SELECT 'run ' || run_id AS filename, seq, round(tsi, 6) AS tsi, round(speed / 3.6 * 3.6, 6) AS speed, {_HR} AS hr, 0.0::DOUBLE AS distance FROM track_points",
    "nearest_land": "SELECT run_id, seq, round(nearest_land_lat, 6) AS nearest_land_lat, round(nearest_land_lon, 6) AS nearest_land_lon FROM land",
    "distance_to_land": f"SELECT run_id, seq, round(distance_to_land, 3) AS distance_to_land FROM land",
    "furthest_from_land": "SELECT run_id, round(max(distance_to_land), 3) AS max_distance FROM land GROUP BY run_id",
    "end_beaches": "SELECT run_id, start_pos, end_pos FROM run_beaches",
    "resolved_runs": "SELECT run_id, start_beach, end_beach, region FROM resolved",
    "match_runs": "SELECT 'run ' || p.run_id AS filename, l.run_id AS id FROM (SELECT run_id, min(tsi) AS t FROM track_points GROUP BY run_id) p JOIN run_list l ON abs(l.ts - p.t) < 300 AND l.sport = 'Downwind'",
    "unmatched_files": "SELECT 'run ' || p.run_id AS filename FROM (SELECT run_id, min(tsi) AS t FROM track_points GROUP BY run_id) p WHERE NOT EXISTS (SELECT 1 FROM run_list l WHERE l.run_id % 3 <> 0 AND abs(l.ts - p.t) < 300)",
    "attach_runs": "SELECT l.run_id AS id, 'run ' || p.run_id AS filename, p.seq FROM track_points p JOIN (SELECT run_id, min(tsi) AS t FROM track_points GROUP BY run_id) f USING (run_id) JOIN run_list l ON abs(l.ts - f.t) < 300",
    "new_files": "SELECT DISTINCT 'run ' || run_id AS filename FROM run_list r WHERE NOT EXISTS (SELECT 1 FROM track_points p WHERE p.run_id = r.run_id AND p.run_id % 2 = 0)",
    "upsert_runs": """SELECT CASE WHEN o.filename IS NULL THEN concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) ELSE o.id END AS id, coalesce(o.filename, n.filename) AS filename, CASE WHEN o.filename IS NULL THEN 'Downwind' ELSE o.sport END AS sport,
      CASE WHEN n.filename IS NULL THEN o.ts ELSE n.ts END AS ts, CASE WHEN n.filename IS NULL THEN o.duration_sec ELSE n.duration_sec END AS duration_sec, o.max_distance FROM
      (SELECT 'id' || run_id AS id, 'run ' || run_id AS filename, 'Wing' AS sport, ts, duration_sec, 5.0::DOUBLE AS max_distance FROM run_list WHERE run_id % 2 = 0) o FULL JOIN
      (SELECT 'run ' || run_id AS filename, ts + 1 AS ts, duration_sec + 2 AS duration_sec, sha256('run ' || run_id) AS h FROM run_list WHERE run_id % 3 <> 0) n ON o.filename = n.filename""",
    "write_back_overwrite": "SELECT r.run_id, round(CASE WHEN s.run_id IS NULL THEN r.duration_sec ELSE s.duration_on_foil END, 6) AS duration_sec FROM run_list r LEFT JOIN (SELECT * FROM foil WHERE run_id % 2 = 0) s USING (run_id)",
    "write_back_fill": "SELECT r.run_id, round(CASE WHEN r.run_id % 3 = 0 THEN s.duration_on_foil ELSE r.duration_sec END, 6) AS duration_sec FROM run_list r LEFT JOIN foil s USING (run_id)",
    "write_back_all": "SELECT r.run_id, round(s.duration_on_foil, 6) AS duration_sec FROM run_list r LEFT JOIN (SELECT * FROM foil WHERE run_id % 2 = 0) s USING (run_id)",
    "import_points": f"SELECT m.run_id, 'run ' || m.run_id AS filename, m.seq, round(m.distance, 4) AS distance, {N('avg_speed_15s', 'avg_speed_1k')}, round(nearest_land_lat, 6) AS nearest_land_lat, round(nearest_land_lon, 6) AS nearest_land_lon FROM means m JOIN land l ON l.run_id = m.run_id AND l.seq = m.seq WHERE m.run_id % 2 = 1",
    "update_runs": f"""SELECT r.run_id AS id, o.ts, r.sport, {R(*['o.' + c for c in _STATS[:4]])}, round(longest_segment_distance, 6) AS longest_segment_distance, {R('duration_on_foil', 'distance_on_foil')}, coalesce(paddle_up_count, 77) AS paddle_up_count, {R('distance_to_first_paddle_up')},
      CASE WHEN r.run_id % 3 = 0 THEN 99 ELSE min_foiling_hr END AS min_foiling_hr, round(CASE WHEN r.run_id % 3 = 0 THEN 98.5 ELSE avg_foiling_hr END + 1e-9, 6) AS avg_foiling_hr, round(CASE WHEN r.run_id % 2 = 0 THEN 12.5 ELSE max_speed_1k END + 1e-9, 6) AS max_speed_1k,
      CASE WHEN r.run_id % 4 = 0 THEN 1.5 ELSE round(away, 3) END AS max_distance, CASE WHEN r.run_id % 10 = 0 THEN 3 ELSE start_pos END AS start_pos, CASE WHEN r.run_id % 10 = 0 THEN 4 ELSE end_pos END AS end_pos
      FROM run_list r JOIN rolled o USING (run_id) LEFT JOIN hearts USING (run_id) LEFT JOIN best1k USING (run_id) LEFT JOIN foil USING (run_id) LEFT JOIN longest USING (run_id) LEFT JOIN paddle USING (run_id) LEFT JOIN firsts USING (run_id) LEFT JOIN run_beaches USING (run_id)
      LEFT JOIN (SELECT run_id, max(distance_to_land) AS away FROM land GROUP BY run_id) a USING (run_id)""",
    "wind_slice_any_age": """SELECT run_id, event_id, round(CASE WHEN rn = 1 THEN ts ELSE tsi END, 6) AS tsi, round(wavg, 6) AS wavg FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tsi, event_id) AS rn FROM (
      SELECT r.run_id, r.ts, w.tsi, w.event_id, w.wavg, w.tsi < r.ts AS early, row_number() OVER (PARTITION BY r.run_id, w.tsi < r.ts ORDER BY w.tsi DESC, w.event_id DESC) AS back
      FROM (SELECT * FROM regions UNION ALL SELECT run_id + 100000, ts + 45 * 86400, duration_sec, region FROM regions) r JOIN wind w ON w.site = CASE r.region WHEN 'AFRICA' THEN 'kihei' WHEN 'AMERICA' THEN 'hookipa' END AND w.tsi <= r.ts + r.duration_sec) x WHERE NOT early OR back = 1) y""",
    "export_ordered_files": "SELECT run_id, true AS several, count(*) AS n, CAST(0 AS BIGINT) AS misplaced FROM track_points GROUP BY run_id",
    "drop_import": """SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS id, 'run ' || run_id AS file, filename, 'Downwind' AS sport, round(ts, 6) AS ts, n, round(distance, 4) AS distance FROM (
      SELECT *, sha256(filename) AS h FROM (SELECT run_id, ts, 'Waterspeed ' || strftime(make_timestamp(CAST(round_even(ts * 1000000, 0) AS BIGINT)), '%Y-%m-%d %H.%M.%S') AS filename FROM run_list) l) x JOIN (SELECT run_id, count(*) AS n, max(distance) AS distance FROM dist GROUP BY run_id) d USING (run_id)""",
    "similar_runs": "SELECT a.run_id, b.run_id AS other, row_number() OVER (PARTITION BY a.run_id ORDER BY b.ts DESC, b.run_id) AS rank FROM resolved a JOIN resolved b ON a.run_id <> b.run_id AND (a.start_pos = b.start_pos OR a.end_pos = b.end_pos) QUALIFY rank <= 20",
    "wind_by_run": f"SELECT run_id, {R('avg_wavg', 'max_wavg', 'avg_wgust', 'max_wgust')}, avg_wdir FROM regions LEFT JOIN wind_stats USING (run_id) WHERE region <> 'ASIA'",
    "run_list_with_wind": f"SELECT run_id, region, {R('avg_wavg', 'max_wgust')}, avg_wdir FROM regions LEFT JOIN wind_stats USING (run_id)",
    "wind_slice": slice_sql("wind", "CASE r.region WHEN 'AFRICA' THEN 'kihei' WHEN 'AMERICA' THEN 'hookipa' END", R("wavg", "wgust", "wdir")),
    "swell_slice": slice_sql("swell", "CASE r.region WHEN 'AMERICA' THEN 'pauwela' END", "round(wave_height * 3.2808399, 6) AS wave_height, " + R("wave_period")),
    "wind_relative": "SELECT run_id, event_id, round(tsi - min(tsi) OVER (PARTITION BY run_id), 6) AS t FROM (" + slice_sql("wind", "CASE r.region WHEN 'AFRICA' THEN 'kihei' WHEN 'AMERICA' THEN 'hookipa' END", "wavg") + ") y",
    "wind_rose": f"""SELECT site, sector, CAST(sector * 10 AS DOUBLE) AS start_deg, {_COMPASS} AS compass, bin, {_LABEL} AS label, n, CAST(sum(n) OVER (PARTITION BY site, sector) AS BIGINT) AS sector_n, round((sum(n) OVER s - n) / total, 6) AS r0, round(sum(n) OVER s / total, 6) AS r1, round(n * 100 / total, 6) AS share FROM
      (SELECT *, CAST(sum(n) OVER (PARTITION BY site) AS DOUBLE) AS total FROM (SELECT site, CAST(floor(wdir / 10) AS INT) AS sector, {_BIN} AS bin, count(*) AS n FROM wind GROUP BY ALL) a) b WINDOW s AS (PARTITION BY site, sector ORDER BY bin ROWS UNBOUNDED PRECEDING)""",
    "crashes": f"SELECT run_id, seq, {R('tsi', 'speed', 'avg_speed')} FROM crashed",
    "crash_density": f"""SELECT q, r, count(*) AS n, CAST(max(count(*)) OVER () AS BIGINT) AS max_n FROM (
      SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM (
      SELECT *, abs(rq - q0) AS dq, abs(rr - r0) AS dr, abs(rs - s0) AS ds FROM (SELECT *, round_even(q0, 0) AS rq, round_even(r0, 0) AS rr, round_even(s0, 0) AS rs FROM (SELECT q0, r0, -q0 - r0 AS s0 FROM (
      SELECT (x * sqrt(3) / 3 - y / 3) / 20 AS q0, y * 2 / 3 / 20 AS r0 FROM (SELECT (radians(lon) + 2.7333) * 200000 AS x, (-ln(tan(pi() / 4 + radians(lat) / 2)) + 0.376) * 200000 AS y FROM crashed) a
      WHERE x BETWEEN 0 AND 960 AND y BETWEEN 0 AND 600) b) c) d) e) f GROUP BY q, r""",
    "run_texts": """SELECT run_id, concat_ws(' ', CASE WHEN duration_sec >= 3600 THEN CAST(floor(duration_sec / 3600) AS INT) || 'h' END, CASE WHEN floor(duration_sec % 3600 / 60) > 0 THEN CAST(floor(duration_sec % 3600 / 60) AS INT) || 'm' END, CASE WHEN duration_sec % 60 >= 0.5 THEN CAST(floor(duration_sec % 60 + 0.5) AS INT) || 's' END) AS duration,
      CASE WHEN s >= 86400 THEN CAST(floor(s / 86400) AS INT) || 'd ' || CAST(floor(s % 86400 / 3600) AS INT) || 'h' WHEN s >= 3600 THEN CAST(floor(s / 3600) AS INT) || 'h ' || CAST(floor(s % 3600 / 60) AS INT) || 'm' ELSE CAST(floor(s / 60) AS INT) || 'm ' || CAST(floor(s % 60) AS INT) || 's' END AS span,
      CAST(floor(60 / avg_speed_kmh) AS INT) || ':' || lpad(CAST(CAST(floor((60 / avg_speed_kmh - floor(60 / avg_speed_kmh)) * 60) AS INT) AS VARCHAR), 2, '0') || ' min/km' AS pace, printf('%.2f kph', max_speed_kmh) AS top, CASE WHEN avg_foiling_hr IS NULL THEN 'unknown bpm' ELSE printf('%.0f bpm', avg_foiling_hr) END AS heart,
      CASE WHEN distance_on_foil < 1000 THEN printf('%.0f m', distance_on_foil) ELSE printf('%.2f km', distance_on_foil / 1000) END AS on_foil, CASE WHEN coalesce(paddle_up_count, 0) = 0 THEN '?' ELSE CAST(paddle_up_count AS VARCHAR) END AS ups,
      printf('%.0fg%.0f knots', max_speed_1k, max_speed_kmh) || CASE WHEN run_id % 3 = 0 THEN '' ELSE ' @' || (run_id % 3) || '°' END AS wind, strftime(make_timestamp(CAST(floor(ts) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS at,
      CASE WHEN duration_sec >= 1000 THEN CAST(CAST(floor(duration_sec) AS BIGINT) // 1000 AS VARCHAR) || ',' || lpad(CAST(CAST(floor(duration_sec) AS BIGINT) % 1000 AS VARCHAR), 3, '0') ELSE CAST(CAST(floor(duration_sec) AS BIGINT) AS VARCHAR) END AS comma, 'Foil ' || run_id AS foil FROM
      (SELECT r.*, r.duration_sec * 70 AS s, h.avg_foiling_hr, f.distance_on_foil, p.paddle_up_count, k.max_speed_1k FROM rolled r LEFT JOIN hearts h USING (run_id) LEFT JOIN foil f USING (run_id) LEFT JOIN paddle p USING (run_id) LEFT JOIN best1k k USING (run_id)) x""",
    "compass": "SELECT event_id, " + ", ".join(f"list_extract([{', '.join(repr(x) for x in names)}], CAST(floor(wdir / {360 / len(names)} + 0.5) AS INT) % {len(names)} + 1) AS p{len(names)}" for names in _POINTS) + " FROM wind",
    "on_off_segments": "SELECT run_id, seq, on_foil, segment FROM segs",
    "segment_stats": f"""SELECT run_id, segment, any_value(on_foil) AS on_foil, round(max(tsi) - min(tsi), 6) AS duration, round(max(distance) - min(distance), 6) AS distance, round(max(speed), 6) AS max_speed, round(avg(speed), 6) AS avg_speed, round(60 / nullif(avg(speed), 0), 6) AS pace,
      round(avg({_HR}), 6) AS avg_hr, max({_HR}) AS max_hr, min({_HR}) AS min_hr FROM segs GROUP BY run_id, segment""",
    "splits": f"SELECT run_id, split, {R('min_speed', 'avg_speed', 'max_speed')}, min_hr, {R('avg_hr')}, max_hr, round(60 / nullif(max_speed, 0), 6) AS min_pace, round(60 / nullif(avg_speed, 0), 6) AS avg_pace, round(60 / nullif(min_speed, 0), 6) AS max_pace FROM split",
    "fastest_1k": "SELECT run_id, round(e_tsi - tsi, 6) AS duration, round(tsi, 6) AS start_tsi, round(e_tsi, 6) AS end_tsi, round(e_distance - distance, 6) AS distance FROM fastest",
    "callouts": f"""SELECT run_id, kind, round(lat, 6) AS lat, round(lon, 6) AS lon, round(value, 6) AS value FROM (
      SELECT run_id, 'top_speed' AS kind, lat, lon, speed AS value FROM track_points QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY speed DESC, tsi, seq) = 1 UNION ALL
      SELECT run_id, 'least_heart_rate', lat, lon, hr FROM track_points JOIN hearts USING (run_id) WHERE speed > 11 AND nullif(hr, 0) = min_foiling_hr QUALIFY row_number() OVER {_W} = 1 UNION ALL
      SELECT run_id, 'start_of_fastest', lat, lon, tsi FROM fastest UNION ALL SELECT run_id, 'end_of_fastest', e_lat, e_lon, e_tsi FROM fastest) x""",
    "speed_classes": """SELECT p.run_id, p.seq, CASE WHEN speed > 11 THEN CAST(len(list_filter(c.cuts, lambda x: x <= p.speed + 1e-9)) + 1 AS INT) ELSE 0 END AS speed_class FROM track_points p LEFT JOIN
      (SELECT run_id, quantile_cont(speed, [1/6, 2/6, 3/6, 4/6, 5/6]) AS cuts FROM track_points WHERE speed > 11 GROUP BY run_id) c USING (run_id)""",
    "scaled_speed": "SELECT run_id, seq, CASE WHEN speed < 11 THEN 'off' ELSE 'on' END AS shade, CASE WHEN speed >= 11 THEN round(coalesce((speed - min(speed) OVER r) / nullif(max(speed) OVER r - min(speed) OVER r, 0), 0.5), 6) END AS scaled FROM track_points WINDOW r AS (PARTITION BY run_id)",
    "split_on_foil": "SELECT run_id, seq, CASE WHEN speed > 11 THEN round(speed, 6) END AS speed_on, CASE WHEN speed <= 11 THEN round(speed, 6) END AS speed_off FROM track_points",
    "progress": "SELECT run_id, seq, round(tsi - min(tsi) OVER (PARTITION BY run_id), 6) AS elapsed, round(distance / max(distance) OVER (PARTITION BY run_id), 6) AS done FROM dist",
    "trend": "SELECT run_id, round(regr_slope(speed, tsi - 1704067200), 9) AS slope, round(regr_intercept(speed, tsi - 1704067200), 4) AS intercept FROM track_points GROUP BY run_id",
    "clean_positions": "SELECT run_id, seq, geo OR bad AS position_outlier, CASE WHEN geo AND bad THEN 'both' WHEN geo THEN 'geometric' WHEN bad THEN 'hdop' ELSE '' END AS position_outlier_reason FROM c_out",
    "clean_hold": "SELECT run_id, seq, round(lat_held, 7) AS lat_held, round(lon_held, 7) AS lon_held FROM held",
    "clean_speed": f"SELECT run_id, seq, {R('speed_2s')} FROM c_speed",
    "clean_hampel": f"SELECT run_id, seq, {R('speed_hampel')}, hampel_outlier FROM c_hampel",
    "clean_despike": f"SELECT run_id, seq, {R('speed_accel')}, accel_outlier FROM c_accel",
    "clean_plateau": f"SELECT run_id, seq, {R('speed_plateau')}, plateau_outlier FROM c_plateau",
    "clean_final": f"SELECT run_id, seq, {R('speed_final')}, sanity_capped, round(distance, 4) AS distance FROM cleaned",
    "clean_summary": "SELECT run_id, count(*) AS n_rows, CAST(count_if(geo OR bad) AS BIGINT) AS n_position_outlier, CAST(count_if(hampel_outlier) AS BIGINT) AS n_hampel_outlier, CAST(count_if(accel_outlier) AS BIGINT) AS n_accel_outlier, CAST(count_if(plateau_outlier) AS BIGINT) AS n_plateau_outlier, CAST(count_if(sanity_capped) AS BIGINT) AS n_sanity_capped, round(max(speed_final), 6) AS max_speed_final FROM cleaned GROUP BY run_id",
    "enriched_runs": "SELECT run_id, strftime(month, '%Y-%m-%d') AS month, strftime(week, '%Y-%m-%d') AS week, dry, round(distance_on_foil / nullif(distance_km * 1000, 0), 6) AS pct_dist_on_foil, round(duration_on_foil / nullif(duration_sec, 0), 6) AS pct_time_on_foil FROM info",
    "dashboard_totals": f"SELECT count(*) AS n_runs, {', '.join(f'round(sum({c}), 4) AS sum_{c}' for c in ('duration_sec', 'distance_km'))}, CAST(sum(paddle_up_count) AS BIGINT) AS sum_paddle_up_count, {', '.join(f'round(max({c}) + 1e-9, 6) AS {c}, arg_max(run_id, struct_pack(v := {c}, t := -ts)) AS {c}_run' for c in ('max_speed_kmh', 'max_speed_1k', 'longest_segment_distance'))} FROM info",
    "outings": "SELECT strftime(month, '%Y-%m-%d') AS month, region, count(*) AS n, round(sum(duration_sec), 4) AS duration_sec, CAST(sum(count(*)) OVER (PARTITION BY month) AS BIGINT) AS month_n, round(sum(sum(duration_sec)) OVER (PARTITION BY month), 4) AS month_duration_sec FROM info GROUP BY info.month, region",
    "weekly_band": "SELECT strftime(week, '%Y-%m-%d') AS week, round(min(max_speed_1k) + 1e-9, 6) AS low, round(max(max_speed_1k) + 1e-9, 6) AS high, count(*) AS n, arg_min(start_beach, ts) AS start_beach, arg_min(end_beach, ts) AS end_beach FROM " + _WEEKS + " i GROUP BY i.week",
    "weekly_heart_rates": "SELECT strftime(week, '%Y-%m-%d') AS week, min(min_foiling_hr) AS low_min_foiling_hr, max(min_foiling_hr) AS high_min_foiling_hr, round(min(avg_foiling_hr), 6) AS low_avg_foiling_hr, round(max(avg_foiling_hr), 6) AS high_avg_foiling_hr, count(*) AS n FROM " + _WEEKS + " i WHERE min_foiling_hr > 0 GROUP BY i.week",
    "launches": "SELECT start_beach, end_beach, count(*) AS n FROM info GROUP BY ALL",
    "beach_totals": "SELECT beach, CAST(sum(a) AS BIGINT) AS launches, CAST(sum(b) AS BIGINT) AS landings FROM (SELECT start_beach AS beach, 1 AS a, 0 AS b FROM info UNION ALL SELECT end_beach, 0, 1 FROM info) x GROUP BY beach",
    "beach_names": "SELECT start_beach AS beach FROM info UNION SELECT end_beach FROM info",
    "dry_runs": "SELECT run_id, ts FROM info WHERE longest_segment_distance / nullif(distance_on_foil, 0) > 0.262 ORDER BY ts DESC",
    "newest_first": "SELECT run_id, ts FROM info ORDER BY ts DESC, run_id",
    "latest_run": "SELECT run_id, ts FROM info ORDER BY ts DESC, run_id LIMIT 1",
    "recent_points": "SELECT p.run_id, p.seq FROM track_points p JOIN run_list r USING (run_id) WHERE r.ts > 1704067200 + 16 * 86400 - 14 * 86400",
    "compare_splits": "SELECT coalesce(l.left_run, r.left_run) AS left_run, coalesce(l.right_run, r.right_run) AS right_run, coalesce(l.split, r.split) AS split, round(l.avg_speed, 6) AS left_avg_speed, round(r.avg_speed, 6) AS right_avg_speed, round(greatest(l.max_speed, r.max_speed), 6) AS top_speed FROM (SELECT run_id AS left_run, run_id + 1 AS right_run, * FROM split WHERE run_id + 1 IN (SELECT run_id FROM run_list)) l FULL JOIN (SELECT run_id - 1 AS left_run, run_id AS right_run, * FROM split WHERE run_id - 1 IN (SELECT run_id FROM run_list)) r ON l.left_run = r.left_run AND l.split = r.split",
    "shared_maxima": "SELECT a.run_id AS left_run, b.run_id AS right_run, round(greatest(a.max_speed_kmh, b.max_speed_kmh), 6) AS max_speed, round(greatest(a.distance_km, b.distance_km) * 1000, 4) AS max_distance, round(greatest(a.duration_sec, b.duration_sec), 6) AS max_duration FROM rolled a JOIN rolled b ON b.run_id = a.run_id + 1",
    "dashboard_totals_land": "SELECT count(*) AS n_runs, round(max(m), 3) AS max_distance, arg_max(run_id, struct_pack(v := m, t := -ts)) AS max_distance_run FROM info LEFT JOIN (SELECT run_id, max(distance_to_land) AS m FROM land GROUP BY run_id) d USING (run_id)",
    "landing_matrix": "SELECT start_beach, " + ", ".join(f"count(*) FILTER (WHERE end_beach = (SELECT beach FROM beaches WHERE beach_id = {i})) AS to_{i}" for i in range(25)) + " FROM info GROUP BY start_beach",
    "weekly_trend": "SELECT CASE WHEN count(*) > 1 THEN round(regr_slope(high, x), 5) END AS slope, CASE WHEN count(*) > 1 THEN round(regr_intercept(high, x), 5) END AS intercept FROM (SELECT date_diff('day', DATE '2024-01-01', week) / 7.0::DOUBLE AS x, max(max_speed_1k) AS high FROM " + _WEEKS + " i GROUP BY week) w",
    "enriched_wind": "SELECT run_id, CASE WHEN run_id % 4 > 0 THEN 'Foil ' || run_id ELSE 'unknown foil' END AS foil, round(avg_wavg, 6) AS avg_avg, round(max_wavg, 6) AS avg_max, round(avg_wgust, 6) AS gust_avg, round(max_wgust, 6) AS gust_max, avg_wdir AS avg_dir FROM regions LEFT JOIN wind_stats USING (run_id)",
    "wind_slice_local": slice_sql("wind", "CASE r.region WHEN 'AFRICA' THEN 'kihei' WHEN 'AMERICA' THEN 'hookipa' END", R("wavg"), 36000),
    "callout_furthest": "SELECT run_id, round(max(distance_to_land), 3) AS value FROM land GROUP BY run_id",
    "segment_land": "SELECT run_id, segment, round(avg(distance_to_land), 3) AS avg_land_distance FROM segs JOIN land USING (run_id, seq) GROUP BY run_id, segment",
    "read_points": f"SELECT 'run ' || run_id AS filename, strftime(make_timestamp({_US}), '%Y-%m-%d') AS date, strftime(make_timestamp({_US}), '%H:%M:%S') AS time, {R('tsi', 'lat', 'lon')}, round(speed / 3.6 * 3.6, 6) AS speed, {_HR} AS hr, 0.0::DOUBLE AS distance FROM track_points",
    "drop_folder": f"SELECT 'run ' || run_id AS filename, {R('tsi')}, round(speed / 3.6 * 3.6, 6) AS speed, {_HR} AS hr FROM track_points",
    "read_run_list": """SELECT 'Waterspeed ' || strftime(make_timestamp(CAST(round_even(ts * 1000000, 0) AS BIGINT)), '%Y-%m-%d %H.%M.%S') AS filename, round(ts, 6) AS ts, 30.5::DOUBLE AS max_speed_kmh, round(duration_sec, 6) AS duration_sec, round(run_id * 1.5::DOUBLE, 6) AS distance_km,
      strftime(make_timestamp(CAST(round_even(ts * 1000000, 0) AS BIGINT)), '%Y-%m-%d') AS date, strftime(make_timestamp(CAST(round_even(ts * 1000000, 0) AS BIGINT)), '%H:%M:%S') AS time, 'Run, no. ' || run_id AS name, run_id % 5 AS feeling, 'Board' AS board, 'Foil 725.0 cm2' AS foil FROM run_list""",
    "list_filenames": "SELECT run_id, 'Waterspeed ' || strftime(make_timestamp(CAST(round_even(ts * 1000000, 0) AS BIGINT)), '%Y-%m-%d %H.%M.%S') AS filename FROM run_list",
    "read_gpx": f"SELECT 'run_' || run_id || '.gpx' AS filename, row_number() OVER {_W} - 1 AS idx, {R('tsi', 'lat', 'lon', 'hdop')}, {_HR} AS hr FROM track_points WHERE event_id % 50 <> 0",
    "read_buoy": "SELECT *, 'meters' AS wave_height_unit, 'seconds' AS wave_period_unit, 'degrees' AS wave_direction_unit, 'degrees' AS water_temp_unit FROM (" + _BUOY + ") b",
    "buoy_table": "SELECT * REPLACE (ts || 'Z' AS ts) FROM (" + _BUOY + ") b",
    "unit_names": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, list_extract(['degrees', 'meters_per_sec', 'seconds', 'hecto_pascal', 'nautical_miles', 'feet', NULL, 'year'], CAST(n_nationkey % 8 + 1 AS INT)) AS unit FROM nation",
    "export_by_partition": f"SELECT site, strftime(day, '%Y-%m-%d') AS day, event_id, {R('tsi', 'wavg', 'wgust', 'wlull', 'wdir')} FROM wind WHERE tsi > {_RECENT}",
    "read_site_day": f"SELECT site, strftime(day, '%Y-%m-%d') AS day, event_id, {R('tsi', 'wavg')} FROM wind WHERE tsi > {_RECENT} AND site = 'kihei' AND day = DATE '2024-01-10'",
    "export_gzip_sorted": f"SELECT site, strftime(day, '%Y-%m-%d') AS day, CAST(1 AS BIGINT) AS files, count(*) AS n, CAST(0 AS BIGINT) AS misplaced FROM wind WHERE tsi > {_RECENT} GROUP BY site, wind.day",
    "export_recent_points": f"SELECT l.run_id, l.seq, round(p.tsi, 6) AS tsi, round(distance_to_land, 3) AS distance_to_land FROM land l JOIN track_points p USING (run_id, seq) JOIN run_list r ON r.run_id = l.run_id WHERE r.ts > {_RECENT}",
    "export_order": f"SELECT run_id, seq, row_number() OVER {_W} AS place FROM track_points",
    "read_run_points": f"SELECT seq, {R('tsi', 'speed')}, strftime(make_timestamp({_US}), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM track_points WHERE run_id = 1",
    "track_rows": f"""SELECT run_id, seq AS idx, {_ISO.format('us')} || '+00:00' AS time_utc, {_ISO.format('us - 36000000000')} || '-10:00' AS time_local, round(lat, 6) AS lat_raw, round(lon_held, 6) AS lon_filtered, round(speed_2s, 3) AS speed_2s_kmh, round(speed_final, 3) AS speed_final_kmh,
      round(distance, 2) AS distance_cumulative_m, hr, CASE WHEN geo AND bad THEN 'both' WHEN geo THEN 'geometric' WHEN bad THEN 'hdop' ELSE '' END AS position_outlier_reason, sanity_capped FROM cleaned""",
    "export_cleaned_tracks": f"SELECT run_id, seq AS idx, {_ISO.format('us')} || '+00:00' AS time_utc, round(lat_held, 6) AS lat_filtered, round(speed_final, 3) AS speed_final_kmh, round(distance, 2) AS distance_cumulative_m, hampel_outlier FROM cleaned",
}
# Windows over pieces give what windows over whole runs give.
BODIES |= {f"{name}_in_pieces": BODIES[of] for name, of in (("distance", "distance_running"), ("islands", "islands"), ("crashes", "crashes"), ("clean_hold", "clean_hold"))}
BODIES["trailing_means_in_pieces"] = f"SELECT run_id, seq, {N('avg_speed_15s', 'avg_speed_1k')} FROM means"
BODIES["overview"] = f"""SELECT CASE GROUPING(i.month, i.region, i.week, i.start_beach, i.end_beach) WHEN 31 THEN 'all' WHEN 15 THEN 'month' WHEN 7 THEN 'region of month' WHEN 27 THEN 'week' WHEN 29 THEN 'launch' WHEN 30 THEN 'landing' ELSE 'way' END AS kind, strftime(i.month, '%Y-%m-%d') AS month, i.region, strftime(i.week, '%Y-%m-%d') AS week, i.start_beach, i.end_beach,
  count(*) AS n, round(sum(duration_sec), 4) AS sum_duration_sec, round(sum(distance_km), 4) AS sum_distance_km, CAST(sum(paddle_up_count) AS BIGINT) AS sum_paddle_up_count, round(min(max_speed_1k) + 1e-9, 6) AS low_speed_1k, round(max(max_speed_1k) + 1e-9, 6) AS high_speed_1k, arg_min(run_id, ts) AS first_run, arg_min(i.start_beach, ts) AS first_from, arg_min(i.end_beach, ts) AS first_to
  FROM (SELECT * REPLACE (CAST(date_trunc('month', make_timestamp(CAST(ts * 1000000 AS BIGINT))) AS DATE) AS month) FROM {_WEEKS} w) i GROUP BY GROUPING SETS ((), (i.month), (i.month, i.region), (i.week), (i.start_beach), (i.end_beach), (i.start_beach, i.end_beach))"""
SQL = {name: f"{CTES}\n{body}" for name, body in BODIES.items()}
