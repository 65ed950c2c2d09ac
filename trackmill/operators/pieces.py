"""Windows over tracks of any length: a track is cut into pieces, and what the rows before a piece leave behind is carried to it.

A run is hours at about one fix a second, and the other modules keep it in one task. A file that merges many runs, or a
logger that never stops, is not so bounded. Here windows run over pieces (by time or by way); a row of sums for each
piece, put in order within its run, carries running totals, the last row and open stretches over the borders; and range
frames see the rows just before a piece, which stand in both. Results are those of tracks, islands, gpsclean and
crashes; distances may differ in the last digits, as sums are taken in another order.

Fixes of one run with equal tsi stand in one piece, as do those of equal distance for the mean over metres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.geo import haversine_m
from .islands import ON_FOIL_KMH
from .tracks import micros

#: Seconds and metres of a piece.
PIECE_S, PIECE_M = 3600.0, 50_000.0


def _cut(points: DataFrame, piece_s: float) -> DataFrame:
    return points.withColumn("__piece", F.floor(micros(F.col("tsi")) / int(piece_s * 1_000_000)))


def _carried(rows: DataFrame, key: str, sums: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """rows with the columns of carry, made one after the other for each piece from sums of it and of the pieces of its run before it."""
    made = rows.groupBy(key, "__piece").agg(*[c.alias(n) for n, c in sums.items()])
    for n, c in carry.items():
        made = made.withColumn(n, c)
    made = made.select(F.col(key).alias("__k"), F.col("__piece").alias("__p"), *carry)
    return rows.join(made, F.col(key).eqNullSafe(F.col("__k")) & F.col("__piece").eqNullSafe(F.col("__p"))).drop("__k", "__p")


def _inside(key: str) -> WindowSpec:
    return Window.partitionBy(key, "__piece").orderBy("tsi", "seq")


def _before(key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy("__piece")


def _so_far(key: str) -> WindowSpec:
    return _before(key).rowsBetween(Window.unboundedPreceding, -1)


def with_distance(points: DataFrame, key: str = "run_id", lat: str = "lat", lon: str = "lon", piece_s: float = PIECE_S) -> DataFrame:
    """tracks.with_distance() in pieces of piece_s seconds."""
    w = _inside(key)
    rows = _cut(points, piece_s).withColumns({"__first": F.lag(F.lit(1)).over(w).isNull(), "step_m": F.coalesce(haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)), F.lit(0.0))})
    at, order = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")), F.struct("tsi", "seq")
    sums = {"__way": F.sum("step_m"), "__head": F.min_by(at, order), "__tail": F.max_by(at, order)}
    last = F.lag("__tail").over(_before(key))
    border = F.coalesce(haversine_m(last["lat"], last["lon"], F.col("__head.lat"), F.col("__head.lon")), F.lit(0.0))
    carry = {"__border": border, "__far": F.coalesce(F.sum(F.col("__way") + F.col("__border")).over(_so_far(key)), F.lit(0.0)) + F.col("__border")}
    met = _carried(rows, key, sums, carry)
    run = F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("distance", F.col("__far") + run).withColumn("step_m", F.when(F.col("__first"), F.col("__border")).otherwise(F.col("step_m"))).drop("__piece", "__first", "__border", "__far")


def with_trailing_means(points: DataFrame, key: str = "run_id", seconds: float = 15, metres: float = 1000, piece_s: float = PIECE_S, piece_m: float = PIECE_M) -> DataFrame:
    """tracks.with_trailing_means() in pieces of piece_s seconds and piece_m metres, which are no shorter than the frames."""
    span, step = int(seconds * 1_000_000), int(piece_s * 1_000_000)
    timed = _framed(points.withColumn("__us", micros(F.col("tsi"))), key, "__us", span, step, "avg_speed_15s").drop("__us")
    return _framed(timed, key, "distance", metres, piece_m, "avg_speed_1k")


def _framed(rows: DataFrame, key: str, along: str, span: float, step: float, into: str) -> DataFrame:
    """rows with the mean speed over the last span of along; a row within span of the end of its piece stands in the next one too."""
    if step < span:
        raise ValueError("a piece must be as long as the frame")
    own = F.floor(F.col(along) / step)
    halo = F.when(F.col(along) >= (own + 1) * step - span, own + 1)
    places = F.when(halo.isNull(), F.array(own)).otherwise(F.array(own, halo))
    both = rows.withColumns({"__own": own, "__piece": F.explode(places)})
    frame = Window.partitionBy(key, "__piece").orderBy(along).rangeBetween(-span, 0)
    return both.withColumn(into, F.avg("speed").over(frame)).filter(F.col("__piece").eqNullSafe(F.col("__own"))).drop("__own", "__piece")


def with_islands(points: DataFrame, key: str = "run_id", limit: float = ON_FOIL_KMH, piece_s: float = PIECE_S) -> DataFrame:
    """islands.with_islands() in pieces of piece_s seconds."""
    w, order = _inside(key), F.struct("tsi", "seq")
    rows = _cut(points, piece_s).withColumn("__fast", F.coalesce(F.col("speed") > limit, F.lit(False)))
    # The first row of a piece is settled by the piece before.
    rows = rows.withColumn("__start", F.when(F.col("__fast") & ~F.coalesce(F.lag("__fast").over(w), F.lit(True)), 1).otherwise(0))
    sums = {"__n": F.sum("__start"), "__head": F.min_by("__fast", order), "__tail": F.max_by("__fast", order)}
    begun = F.when(F.col("__head") & ~F.coalesce(F.lag("__tail").over(_before(key)), F.lit(False)), 1).otherwise(0)
    met = _carried(rows, key, sums, {"__border": begun, "__far": F.coalesce(F.sum(F.col("__n") + F.col("__border")).over(_so_far(key)), F.lit(0)) + F.col("__border")})
    return met.withColumn("island", F.col("__far") + F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__piece", "__start", "__border", "__far")


def with_last(points: DataFrame, value: Column, into: str, key: str = "run_id", piece_s: float = PIECE_S) -> DataFrame:
    """points with the last value that is not null, up to and including each row: positions held, states debounced."""
    w, order = _inside(key), F.struct("tsi", "seq")
    rows = _cut(points, piece_s).withColumn("__value", value)
    sums = {"__tail": F.max_by("__value", F.when(F.col("__value").isNotNull(), order))}
    met = _carried(rows, key, sums, {"__far": F.last("__tail", ignorenulls=True).over(_so_far(key))})
    held = F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn(into, F.coalesce(held, F.col("__far"))).drop("__piece", "__value", "__far")


def crashes(points: DataFrame, key: str = "run_id", mean_over: float = 15, now_below: float = 5, before: float = 5, window_s: float = 15, margin_s: float = 300, piece_s: float = PIECE_S) -> DataFrame:
    """crashes.crashes() in pieces of piece_s seconds."""
    timed = _framed(points.withColumn("__us", micros(F.col("tsi"))), key, "__us", int(window_s * 1_000_000), int(piece_s * 1_000_000), "avg_speed").drop("__us")
    w = _inside(key)
    rows = _cut(timed, piece_s).withColumns({"__first": F.lag(F.lit(1)).over(w).isNull(), "__prev": F.lag("speed").over(w)})
    whole = Window.partitionBy(key)
    sums = {"__tail": F.max_by("speed", F.struct("tsi", "seq")), "__a": F.min("tsi"), "__b": F.max("tsi")}
    met = _carried(rows, key, sums, {"__far": F.lag("__tail").over(_before(key)), "__lo": F.min("__a").over(whole), "__hi": F.max("__b").over(whole)})
    prev = F.coalesce(F.when(F.col("__first"), F.col("__far")).otherwise(F.col("__prev")), F.lit(0.0))
    hit = (F.col("avg_speed") > mean_over) & (F.col("speed") < now_below) & (prev >= before)
    return met.filter(hit & (F.col("tsi") > F.col("__lo") + margin_s) & (F.col("tsi") < F.col("__hi") - margin_s)).drop("__piece", "__first", "__prev", "__far", "__lo", "__hi")
