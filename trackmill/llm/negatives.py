"""Hard negatives of anchors: exact integer scores by Kronecker-packed products.

Components become integers, floor(SCALE * x). Biased so that none is negative, the same component of several candidates
goes into separate fields of one wide integer; the sum over components of anchor component times wide integer then holds
all their inner products side by side, each in a field wide enough never to run over, and one multiplication serves all.
The fields are unpacked and freed of the bias. Where two fields or more fit the 53 bits that a double holds exactly, the
wide integers are doubles, so that matrix products apply; where components are too large for that, they are
Python's integers of any width, FIELDS candidates in each.

Candidates are packed into blocks of one label and length, whatever table they came in; anchors go in chunks of bounded
size, each of which meets all blocks twice: those of its own labels for the positives, the others for the negatives.
A task keeps the best few of each anchor (and positive) over all its blocks and passes on no more than those.

Definitions at the edges: rows with a null label, a null vector, or any null or non-finite component take no part, nor do
null ids; vectors of each length are scored among themselves; rows of an anchor's own id are neither positives nor
negatives of it; other repeated rows count each; equal anchors count once; ties go to the smaller id; an anchor without
positives, and a positive without negatives, has no rows. Scores beyond 64 bits are held at the ends of that range.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, keep, trim

SCALE = 256
#: Candidates in a block at most.
BLOCK = 4096
#: Bytes of anchors that travel to the tasks at once.
CHUNK_BYTES = 32 << 20
#: Scores that a task holds at once.
SCORES = 1 << 20
#: Bits of a wide integer held as a double; candidates in one of Python's.
DOUBLE_BITS, FIELDS = 53, 8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Block(NamedTuple):
    """Rows of one label and length: ids ascending, a matrix of integer components."""

    label: int
    ids: np.ndarray
    x: np.ndarray


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) in the smallest type that holds it."""
    y = np.floor(scale * x)
    most = np.abs(y).max(initial=0)
    for kind, limit in ((np.int16, 1 << 15), (np.int32, 1 << 31), (np.int64, 1 << 62)):
        if most < limit:
            return y.astype(kind)
    out = np.empty(y.shape, dtype=object)
    out[...] = [[int(v) if np.isfinite(v) else int(w) * scale for v, w in zip(*rows, strict=True)] for rows in zip(y.tolist(), x.tolist(), strict=True)]
    return out


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of each of anchors with each of rows, both of integer components."""
    m, n = len(anchors), len(rows)
    if not rows.shape[1]:
        return np.zeros((m, n), np.int64)
    over_a, over_x = int(np.abs(anchors).max(initial=0)), int(np.abs(rows).max(initial=0))
    width = (rows.shape[1] * 4 * max(over_a, 1) * max(over_x, 1)).bit_length()
    fields = DOUBLE_BITS // width
    kind = np.float64 if fields >= 2 else object
    fields = fields if fields >= 2 else FIELDS
    exact = np.int64 if kind is np.float64 else object
    a, x = anchors.astype(exact) + over_a, rows.astype(exact) + over_x
    room = -n % fields
    wide = np.concatenate([x, np.zeros((room, x.shape[1]), x.dtype)]).reshape(-1, fields, x.shape[1])
    packed = wide[:, 0].copy()
    for k in range(1, fields):
        packed += wide[:, k] << (width * k) if kind is np.float64 else wide[:, k] * (1 << (width * k))
    sums = a.astype(kind) @ packed.astype(kind).T
    sums = sums.astype(exact)
    mask = (1 << width) - 1
    scores = np.stack([(sums >> (width * k)) & mask for k in range(fields)], axis=2).reshape(m, -1)[:, :n]
    # The bias of either side is taken out again.
    scores = scores - over_x * a.sum(axis=1)[:, None] - over_a * x.sum(axis=1)[None, :] + rows.shape[1] * over_a * over_x
    return scores if exact is np.int64 else np.clip(scores, _LEAST, _MOST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of each row; ties: the smaller id. A score of _LEAST marks none."""
    if scores.shape[1] > 4 * k:
        # Whatever is no worse than the k-th best; ties with it are sorted out below, ids ascend along a row.
        kth = ~np.partition(~scores, k - 1, axis=1)[:, k - 1 : k]
        ok = scores >= kth
        if ok.sum(axis=1).max() <= 4 * k:
            at = np.argsort(~ok, axis=1, kind="stable")[:, : 4 * k]
            scores, ids = np.where(np.take_along_axis(ok, at, axis=1), np.take_along_axis(scores, at, axis=1), _LEAST), np.take_along_axis(ids, at, axis=1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def ceil_div(a: np.ndarray, b: int) -> np.ndarray:
    return -((-a) // b)


def scaled(score: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the whole numbers n with 100 n at least (first) and at most (second) factor * score, without running over."""
    whole, rest = score // 100, score % 100
    return whole * factor + ceil_div(rest * factor, 100), whole * factor + rest * factor // 100


def usable(vector: Column, label: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


_BLOCK = "label long, size int, ids binary, vectors binary"


def _pack(ids: np.ndarray, x: np.ndarray) -> tuple[bytes, bytes]:
    by = np.argsort(ids, kind="stable")
    return ids[by].tobytes(), np.ascontiguousarray(x[by]).tobytes()


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (vec_id, label, vector) in blocks of one label and length, packed as they come: full ones, and the rest at the end of a task."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def full(key: tuple[int, int]) -> pa.RecordBatch:
            ids, x = (np.concatenate(p) for p in zip(*waiting.pop(key), strict=True))
            cuts = [_pack(ids[i : i + block], x[i : i + block]) for i in range(0, len(ids), block)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(cuts), pa.int64()), pa.array([key[1]] * len(cuts), pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*cuts, strict=True)]], ["label", "size", "ids", "vectors"])

        for batch in batches:
            column = batch.column("vector")
            sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes, dtype=np.int64) - sizes
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            keys, whose = np.unique(np.stack([labels, sizes.astype(np.int64)], axis=1), axis=0, return_inverse=True)
            for k, (label, size) in enumerate(keys.tolist()):
                at = np.flatnonzero(whose.reshape(-1) == k)
                x = flat[starts[at][:, None] + np.arange(size)[None, :]]
                waiting.setdefault((label, size), []).append((ids[at], x))
                held += len(at)
                if sum(len(p[0]) for p in waiting[label, size]) >= block:
                    held -= sum(len(p[0]) for p in waiting[label, size])
                    yield full((label, size))
            if held >= 16 * block:  # many labels: hand on what there is
                yield from map(full, list(waiting))
                held = 0
        yield from map(full, list(waiting))
        trim()

    own = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"), F.col("label")))
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(packed, _BLOCK)


def opened(label: int, size: int, ids: bytes, vectors: bytes, scale: int) -> Block:
    own = np.frombuffer(ids, np.int64)
    return Block(label, own, quantised(np.frombuffer(vectors, np.float64).reshape(len(own), size), scale))


def chunks(anchors: DataFrame, scale: int, limit: int = CHUNK_BYTES) -> Iterator[list[Block]]:
    """Kept anchors, some limit bytes of them at a time, in one block for each label and length."""
    some: list[Block] = []
    used = 0

    def merged() -> list[Block]:
        like: dict[tuple[int, int], list[Block]] = {}
        for b in some:
            like.setdefault((b.label, b.x.shape[1]), []).append(b)
        return [Block(label, np.concatenate([b.ids for b in bs]), np.concatenate([b.x for b in bs])) for (label, _), bs in like.items()]

    for r in anchors.toLocalIterator():
        some.append(opened(r["label"], r["size"], bytes(r["ids"]), bytes(r["vectors"]), scale))
        used += len(r["vectors"]) + len(r["ids"])
        if used >= limit:
            yield merged()
            some, used = [], 0
    if some:
        yield merged()


def in_steps(anchors: Block, rows: int) -> Iterator[tuple[int, int]]:
    step = max(1, SCORES // max(1, rows))
    for a in range(0, len(anchors.ids), step):
        yield a, min(a + step, len(anchors.ids))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, vector).

    The positives of an anchor are its best other rows of the same label; the negatives of each are the best rows of other
    labels whose score is from low to high percent of the positive's. Written in full before this returns.
    """
    spark = vectors.sparkSession
    own = vectors.select("vec_id", "label", "vector", is_anchor.alias("__anchor"))
    packed = keep(blocks(own, block), "blocks")
    anchors = keep(blocks(own.filter("__anchor").drop("__anchor").distinct(), block), "anchors")
    out = None
    for chunk in chunks(anchors, scale, chunk_bytes):
        near = _positives(spark, packed, chunk, positives, scale)
        part = _negatives(spark, packed, chunk, near, negatives, low, high, scale)
        out = part if out is None else out.unionByName(part)
        forget(near)
    forget(packed, anchors)
    found = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], found) if out is None else out


def _positives(spark: SparkSession, packed: DataFrame, chunk: list[Block], k: int, scale: int) -> DataFrame:
    """b, a (block and place of an anchor in the chunk), place, vec_id, score."""
    shared = spark.sparkContext.broadcast(chunk)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                for b, anchors in enumerate(shared.value):
                    if anchors.label != r["label"] or anchors.x.shape[1] != r["size"]:
                        continue
                    rows = opened(scale=scale, **r)
                    if b not in kept:
                        kept[b] = np.full((len(anchors.ids), k), _LEAST), np.zeros((len(anchors.ids), k), np.int64)
                    for lo, hi in in_steps(anchors, len(rows.ids)):
                        score = np.maximum(products(anchors.x[lo:hi], rows.x), _LEAST + 1)
                        score[anchors.ids[lo:hi, None] == rows.ids[None, :]] = _LEAST
                        top = best(score, np.broadcast_to(rows.ids, score.shape), k)
                        both = [np.concatenate([kept[b][i][lo:hi], top[i]], axis=1) for i in (0, 1)]
                        kept[b][0][lo:hi], kept[b][1][lo:hi] = best(*both, k)
        for b, (score, ids) in kept.items():
            a, place = np.nonzero(score != _LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), b, np.int32)), pa.array(a.astype(np.int32)), pa.array(ids[a, place]), pa.array(score[a, place])], ["b", "a", "vec_id", "score"])
        trim()

    found = packed.mapInArrow(scored, "b int, a int, vec_id long, score long")
    order = Window.partitionBy("b", "a").orderBy(F.desc("score"), "vec_id")
    out = keep(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("b", "a", "place", "vec_id", "score"), "positives")
    shared.destroy()
    return out


def _negatives(spark: SparkSession, packed: DataFrame, chunk: list[Block], near: DataFrame, k: int, low: int, high: int, scale: int) -> DataFrame:
    # A few numbers for each anchor of the chunk: they are bounded as the chunk is.
    most = max((r[0] for r in near.agg(F.max("place")).collect() if r[0]), default=0)
    score = [np.full((len(c.ids), most), _LEAST) for c in chunk]
    for batch in near.select("b", "a", "place", "score").toArrow().to_batches():
        for b in np.unique(batch.column("b").to_numpy()).tolist():
            at = batch.column("b").to_numpy() == b
            score[b][batch.column("a").to_numpy()[at], batch.column("place").to_numpy()[at] - 1] = batch.column("score").to_numpy()[at]
    shared = spark.sparkContext.broadcast((chunk, score))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                rows = None
                for b, (anchors, of) in enumerate(zip(*shared.value, strict=True)):
                    if anchors.label == r["label"] or anchors.x.shape[1] != r["size"] or not most:
                        continue
                    rows = rows or opened(scale=scale, **r)
                    if b not in kept:
                        kept[b] = np.full((len(anchors.ids), most, k), _LEAST), np.zeros((len(anchors.ids), most, k), np.int64)
                    for lo, hi in in_steps(anchors, len(rows.ids)):
                        got = np.maximum(products(anchors.x[lo:hi], rows.x), _LEAST + 1)
                        got[anchors.ids[lo:hi, None] == rows.ids[None, :]] = _LEAST
                        for p in range(most):
                            least, top = scaled(of[lo:hi, p], low)[0], scaled(of[lo:hi, p], high)[1]
                            # What is worse than the worst kept does not count; of equals the smaller id may.
                            least = np.maximum(least, kept[b][0][lo:hi, p, -1])
                            fits = (got >= least[:, None]) & (got <= top[:, None]) & (got != _LEAST) & (of[lo:hi, p] != _LEAST)[:, None]
                            some = np.flatnonzero(fits.any(axis=1))
                            if not len(some):
                                continue
                            new = best(np.where(fits[some], got[some], _LEAST), np.broadcast_to(rows.ids, (len(some), len(rows.ids))), k)
                            both = [np.concatenate([kept[b][i][lo + some, p], new[i]], axis=1) for i in (0, 1)]
                            kept[b][0][lo + some, p], kept[b][1][lo + some, p] = best(*both, k)
        for b, (found, ids) in kept.items():
            a, p, place = np.nonzero(found != _LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), b, np.int32)), pa.array(a.astype(np.int32)), pa.array((p + 1).astype(np.int32)), pa.array(ids[a, p, place]), pa.array(found[a, p, place]), pa.array(shared.value[0][b].ids[a])], ["b", "a", "place", "negative_id", "negative_score", "anchor_id"])
        trim()

    found = packed.mapInArrow(scored, "b int, a int, place int, negative_id long, negative_score long, anchor_id long")
    order = Window.partitionBy("b", "a", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = near.select("b", "a", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = keep(ranked.join(named, ["b", "a", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    shared.destroy()
    return out
