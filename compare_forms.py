"""Times some operators against the plain forms that they replace, on one machine: three warm runs each, median.

BENCH_SF_DIR and BENCH_CPUS as in bench.py. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.operators import conditions, gpsclean, grid, nearest, segments, tracks
from trackmill.plans import fixtures, queries


def land_product(points: DataFrame, coast: DataFrame) -> DataFrame:
    """Every fix with every segment."""
    spans = coast.select("feature_id", "lat1", "lon1", (F.coalesce("lat2", "lat1") - F.col("lat1")).alias("dlat"), (F.coalesce("lon2", "lon1") - F.col("lon1")).alias("dlon"))
    y, x, square = grid.point_on(F.col("lat"), F.col("lon"))
    met = points.select("lat", "lon").distinct().crossJoin(F.broadcast(spans)).select("lat", "lon", "feature_id", y.alias("y"), x.alias("x"), square.alias("d"))
    return met.groupBy("lat", "lon", "feature_id").agg(F.min_by("y", "d").alias("y"), F.min_by("x", "d").alias("x"))


def mean_by_pairs(dist: DataFrame) -> DataFrame:
    a = dist.select("run_id", "seq", "distance")
    b = dist.select(F.col("run_id").alias("r"), F.col("distance").alias("d"), "speed")
    return a.join(b, (F.col("run_id") == F.col("r")) & (F.col("d") <= F.col("distance")) & (F.col("d") >= F.col("distance") - 1000)).groupBy("run_id", "seq").agg(F.avg("speed").alias("avg_speed_1k"))


def fastest_by_pairs(dist: DataFrame) -> DataFrame:
    a = dist.select("run_id", "seq", "tsi", "distance")
    b = dist.select(F.col("run_id").alias("r"), F.col("distance").alias("d"), F.col("tsi").alias("t"))
    met = a.join(b, (F.col("run_id") == F.col("r")) & (F.col("d") >= F.col("distance") + 1000)).groupBy("run_id", "seq", "tsi").agg(F.min("t").alias("t"))
    return met.groupBy("run_id").agg(F.min(F.col("t") - F.col("tsi")).alias("duration"))


def hampel_in_pandas(rows: DataFrame) -> DataFrame:
    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tsi", "seq"])
        t, v = pdf["tsi"].to_numpy(), pdf["speed_2s"].to_numpy()
        lo, hi = np.searchsorted(t, t - 12, "left"), np.searchsorted(t, t + 12, "right")
        med = np.array([np.median(v[a:b]) for a, b in zip(lo, hi, strict=True)])
        mad = np.array([np.median(np.abs(v[a:b] - m)) for a, b, m in zip(lo, hi, med, strict=True)])
        off = np.abs(v - med)
        hit = (hi - lo >= 3) & (off > 8) & (off / (1.4826 * np.maximum(mad, 3 / 1.4826)) > 4)
        return pd.DataFrame({"run_id": pdf["run_id"], "seq": pdf["seq"], "speed_hampel": np.where(hit, med, v)})

    return rows.select("run_id", "seq", "tsi", "speed_2s").groupBy("run_id").applyInPandas(track, "run_id long, seq long, speed_hampel double")


def wind_by_range(runs: DataFrame, wind: DataFrame) -> DataFrame:
    asked = runs.select("run_id", conditions.site_of(F.col("region"), fixtures.SITES).alias("s"), "ts", "duration_sec")
    met = asked.join(wind, (F.col("s") == F.col("site")) & (F.col("tsi") >= F.col("ts") - 1800) & (F.col("tsi") <= F.col("ts") + F.col("duration_sec")))
    return met.groupBy("run_id").agg(F.avg("wavg").alias("avg_wavg"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    view = lambda name: fixtures.view(spark, sf_dir, name)
    dist, pts = queries.dist(spark, sf_dir), queries.pts(spark, sf_dir)
    speeds = gpsclean.instant_speed(gpsclean.hold_positions(gpsclean.flag_positions(pts)), window_s=4)
    runs = queries.regions(spark, sf_dir)
    pairs = {
        "nearest_land": (nearest.nearest_land(pts, view("coast_segments")), land_product(pts, view("coast_segments"))),
        "trailing_mean_1k": (tracks.with_trailing_means(dist), mean_by_pairs(dist)),
        "fastest_1k": (segments.fastest(dist), fastest_by_pairs(dist)),
        "hampel": (gpsclean.hampel(speeds), hampel_in_pandas(speeds)),
        "wind_by_run": (conditions.wind_by_run(runs, view("wind"), fixtures.SITES), wind_by_range(runs, view("wind"))),
    }
    out = {}
    for name, forms in pairs.items():
        out[name] = []
        for df in forms:
            took = []
            for _ in range(4):
                start = time.perf_counter()
                df.write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - start)
            out[name].append(round(statistics.median(took[1:]), 2))
    print(json.dumps({"seconds": out, "order": "ours, plain form", "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
