"""Views of tracks, runs, beaches, coast and readings derived from the star-schema tables, in SQL both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view in dependence order; DIV stands for integer division, D(x) for a DOUBLE literal.
VIEWS = {
    "track_seq": """SELECT user_id DIV 10 AS run_id, event_id, value, row_number() OVER (PARTITION BY user_id DIV 10 ORDER BY ts, event_id) AS seq FROM {events}""",
    "track_points": """SELECT CAST(run_id AS BIGINT) AS run_id, CAST(seq AS BIGINT) AS seq, event_id,
        CAST(1704067200 + run_id * 21600 + seq * 2 AS DOUBLE) + CAST(event_id % 4 AS DOUBLE) / CAST(4 AS DOUBLE) AS tsi,
        greatest(CAST(4 AS DOUBLE) + CAST(20 AS DOUBLE) * abs(CAST((seq + 37 * run_id) % 240 - 120 AS DOUBLE)) / CAST(120 AS DOUBLE) + CAST(value AS DOUBLE) % CAST(4 AS DOUBLE)
            - CASE WHEN event_id % 97 = 0 THEN CAST(20 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CAST(0 AS DOUBLE)) AS speed,
        CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 110 + event_id % 60 END AS INT) AS hr,
        CAST(20.8 AS DOUBLE) + CAST(0.01 AS DOUBLE) * CAST(run_id % 25 AS DOUBLE) + CAST(0.00005 AS DOUBLE) * CAST(seq AS DOUBLE) + CASE WHEN event_id % 89 = 0 THEN CAST(0.002 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS lat,
        CAST(-156.6 AS DOUBLE) + CAST(0.00008 AS DOUBLE) * CAST(seq AS DOUBLE) AS lon,
        CASE WHEN event_id % 53 = 0 THEN CAST(8 AS DOUBLE) ELSE CAST(1.2 AS DOUBLE) END AS hdop FROM {track_seq}""",
    "run_list": """SELECT run_id, min(tsi) + CAST(run_id % 7 * 20 AS DOUBLE) AS ts, max(tsi) - min(tsi) AS duration_sec, 'Downwind' AS sport FROM {track_points} GROUP BY run_id""",
    "beaches": """SELECT CAST(n_nationkey AS BIGINT) AS beach_id, n_name AS beach, r_name AS region, CAST(20.8 AS DOUBLE) + CAST(0.01 AS DOUBLE) * CAST(n_nationkey AS DOUBLE) AS lat,
        CAST(-156.6 AS DOUBLE) + CAST(0.002 AS DOUBLE) * CAST(n_nationkey AS DOUBLE) AS lon FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "coast_vertices": """SELECT CAST(s_nationkey AS BIGINT) AS feature_id, CAST(s_suppkey AS BIGINT) AS vertex_id, CAST(20.7 AS DOUBLE) + CAST(0.0035 AS DOUBLE) * CAST(s_suppkey % 101 AS DOUBLE) AS lat,
        CAST(-156.65 AS DOUBLE) + CAST(0.0021 AS DOUBLE) * CAST((s_suppkey * 7) % 53 AS DOUBLE) AS lon FROM {supplier}""",
    "coast_segments": """SELECT feature_id, vertex_id AS seg_id, lat AS lat1, lon AS lon1, lat2, lon2 FROM (SELECT *, lead(lat) OVER (PARTITION BY feature_id ORDER BY vertex_id) AS lat2,
        lead(lon) OVER (PARTITION BY feature_id ORDER BY vertex_id) AS lon2, count(*) OVER (PARTITION BY feature_id) AS n FROM {coast_vertices}) x WHERE lat2 IS NOT NULL OR n = 1""",
    "wind": """SELECT CASE WHEN event_type = 'view' THEN 'kihei' ELSE 'hookipa' END AS site, EPOCH AS tsi, CAST(ts AS DATE) AS day, CAST(10 AS DOUBLE) + CAST(value AS DOUBLE) % CAST(20 AS DOUBLE) AS wavg,
        CAST(10 AS DOUBLE) + CAST(value AS DOUBLE) % CAST(20 AS DOUBLE) + CAST(value AS DOUBLE) % CAST(7 AS DOUBLE) AS wgust, CAST(10 AS DOUBLE) + CAST(value AS DOUBLE) % CAST(20 AS DOUBLE) - CAST(value AS DOUBLE) % CAST(5 AS DOUBLE) AS wlull,
        CAST((event_id * 37) % 360 AS DOUBLE) AS wdir, event_id FROM {events} WHERE event_type IN ('view', 'click')""",
    "swell": """SELECT 'pauwela' AS site, EPOCH AS tsi, CAST(ts AS DATE) AS day, CAST(1 AS DOUBLE) + CAST(value AS DOUBLE) % CAST(3 AS DOUBLE) AS wave_height, CAST(6 + event_id % 9 AS DOUBLE) AS wave_period,
        CAST((event_id * 11) % 360 AS DOUBLE) AS wave_direction, CAST(24 AS DOUBLE) + CAST(value AS DOUBLE) % CAST(2 AS DOUBLE) AS water_temp, event_id FROM {events} WHERE event_type = 'purchase'""",
}
_TABLES = ("events", "nation", "region", "supplier")
SITES = {"AFRICA": "kihei", "AMERICA": "hookipa"}
SWELL_SITES = {"AMERICA": "pauwela"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    sql = VIEWS[name].replace("EPOCH", "CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / CAST(1000000 AS DOUBLE)")
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") if n in _TABLES else view(spark, sf_dir, n) for n in (*_TABLES, *VIEWS) if f"{{{n}}}" in sql}
    return spark.sql(sql, **used)


def duck() -> str:
    """All views as the start of a WITH clause for DuckDB."""
    out = []
    for name, sql in VIEWS.items():
        for n in (*_TABLES, *VIEWS):
            sql = sql.replace(f"{{{n}}}", n)
        out.append(f"{name} AS ({sql.replace(' DIV ', ' // ').replace('EPOCH', 'CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) / CAST(1000000 AS DOUBLE)')})")
    return "WITH RECURSIVE " + ",\n".join(out)
