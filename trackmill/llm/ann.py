"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed. There are about half as many lists as
the square root of the vectors: beyond COARSE_LISTS each coarse list is divided by a second set of centroids, of
residuals, which all lists share, so the lists go on growing though the sample does not. An index row is a block of up to
BLOCK vectors of one list (a list of any size is many blocks): ids, codes and the vectors themselves. Queries
travel to the lists they probe in groups of QUERY_GROUP, so a task scores a group against a block at once with the
queries' asymmetric scores (one product of matrices: whole queries by what the codes stand for, which are the sums of
their tables' entries), and keeps the RERANK * k best of each query at most: only those that may be no worse than the
query's k-th best in the fitted sample, whose vectors are candidates as well. By how much such a score may be too low
is the largest shortfall of the sampled queries' true neighbours, measured while fitting. Those kept are scored exactly in
double precision, and k at most that are no worse are passed on. The k best over all blocks follow by a window over each query. A list of many blocks
is dealt out in parts of about PART_BLOCKS, each of which gets the list's query groups, so no list need fit a task
and equal vectors in any number only add parts.

The number of lists probed is the smallest that reaches TARGET recall on sampled queries against the
sample, measured while fitting. Definitions at the edges: vectors that are null, zero, or hold null or non-finite
components take no part, nor do null ids; vectors of each length are searched among themselves, as others have no inner
product with them; ties go to the smaller id; repeated ids are candidates each but never for a query of the same id;
fewer than k candidates: all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Bound of the vectors that centroids and codebooks are fitted on.
FIT_VECTORS = 16_384
COARSE_LISTS = 2048
#: Scores of queries by lists that are held at once.
PLAN_SCORES = 1 << 19
SUBSPACES = 16
CODES = 64
BLOCK = 2048
PART_BLOCKS = 16
QUERY_GROUP = 256
#: Queries that wait for their groups to fill, counted once for each list they probe; then all groups go as they are.
WAITING = 100_000
RERANK = 8
TARGET = 0.96


@dataclass
class Index:
    centroids: np.ndarray
    fine: np.ndarray  # residuals that divide each centroid's list; one of zeros if there are few lists
    books: np.ndarray  # subspace, code, component
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray

    sample_list: np.ndarray
    margin: float = 0.0  # by how much the tables' score of a true neighbour may be too low, for a query of length 1

    @property
    def lists(self) -> int:
        return len(self.centroids) * len(self.fine)

    def centre(self, own: np.ndarray | int) -> np.ndarray:
        """What the vectors of a list are residuals from."""
        return self.centroids[own // len(self.fine)] + self.fine[own % len(self.fine)]

    def own_list(self, x: np.ndarray) -> np.ndarray:
        own = nearest(x, self.centroids)
        return own * len(self.fine) + nearest(x - self.centroids[own], self.fine)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists by falling inner product of each query with their centres."""
        score = (q @ self.centroids.T)[:, :, None] + (q @ self.fine.T)[:, None, :]
        return np.argsort(-score.reshape(len(q), -1), axis=1, kind="stable")

    def plan(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which lists each query probes, and the least score that is of use from each.

        The nearest lists in number, and on until they hold twice k of the sample. Those first ones that do return
        their best whatever it is, so that no query stays short; from the others only a score counts that is no worse
        than the k-th best of the sample's vectors in all probed lists.
        """
        order = self.order(q)
        size = np.bincount(self.sample_list, minlength=self.lists)[order]
        full = np.cumsum(size, axis=1) - size >= 2 * k + 1
        ahead = np.zeros_like(full)
        np.put_along_axis(ahead, order, ~full, axis=1)
        full[:, : self.probes] = False
        probed = np.zeros_like(full)
        np.put_along_axis(probed, order, ~full, axis=1)
        floor = np.full(len(q), -np.inf)
        if len(self.sample_ids) >= k:
            score = np.where(probed[:, self.sample_list], q @ self.sample.astype(np.float64).T, -np.inf)
            score[ids[:, None] == self.sample_ids[None, :]] = -np.inf
            floor = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            floor -= np.where(np.isfinite(floor), 1e-9 * (1 + np.abs(floor)), 0)
        return probed, np.where(ahead, -np.inf, floor[:, None])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        size = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List and codes of each vector."""
    own = index.own_list(x)
    rest = (x - index.centre(own)).reshape(len(x), len(index.books), -1)
    return own, np.stack([nearest(rest[:, m], index.books[m]) for m in range(len(index.books))], axis=1).astype(np.uint8)


def asymmetric(index: Index, own: int, codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole queries with what a list's codes stand for: the sums of the queries' table entries, by one product of matrices."""
    return q @ (index.centre(own) + index.books[np.arange(len(index.books)), codes].reshape(len(codes), -1)).T


def promising(index: Index, q: np.ndarray, near: np.ndarray, floor: np.ndarray, most: int) -> np.ndarray:
    """Which vectors of a block (near: their scores by table) may be no worse than each query's floor; of more than most, the best by table."""
    least = floor - index.margin * np.linalg.norm(q, axis=1)
    met = near >= np.maximum(least, np.finfo(np.float64).min)[:, None]
    for i in np.flatnonzero(np.count_nonzero(met, axis=1) > most).tolist():
        nudged = near[i] - np.arange(near.shape[1]) * (1e-12 * (1 + np.abs(near[i][met[i]]).max()))  # ids ascend, so ties keep the smaller
        met[i, np.argpartition(-nudged, most - 1)[most:]] = False
    return met


def usable(vector: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda v: v != 0)


def fit(vectors: DataFrame, fit_vectors: int = FIT_VECTORS, k: int = 20, target: float = TARGET, seed: int = 7, lists: int | None = None, coarse: int = COARSE_LISTS) -> Index | None:
    """Index of about so many lists (by default from the number of vectors) from a hash sample of vectors (vec_id, vector), fit_vectors of them at most in expectation."""
    count = vectors.count()
    if not count:
        return None
    part = min(1.0, fit_vectors / count)
    some = vectors.filter(F.pmod(F.xxhash64(F.lit("fit"), "vec_id", "vector"), F.lit(1_000_000)) < part * 1_000_000) if part < 1 else vectors
    # Repeated rows count once, so the sample keeps its bound whatever is repeated.
    rows = some.select("vec_id", "vector").distinct().collect() or vectors.select("vec_id", "vector").limit(1).collect()
    x, ids = np.array([r[1] for r in rows], dtype=np.float64), np.array([r[0] for r in rows], dtype=np.int64)
    by = np.lexsort((*x.T[::-1], ids)[::-1])  # whatever order the rows came in
    x, ids = x[by], ids[by]
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    lists = lists or 2 ** round(math.log2(max(1.0, count**0.5 / 2)))
    centroids = kmeans(np.unique(x, axis=0), min(lists, coarse, len(np.unique(x, axis=0))), 8, rng)
    apart = x - centroids[nearest(x, centroids)]
    fine = kmeans(np.unique(apart, axis=0), min(-(-lists // coarse), len(np.unique(apart, axis=0))), 8, rng) if lists > coarse else np.zeros((1, dims))
    index = Index(centroids, fine, np.zeros((0, 0, 0)), 1, ids, x.astype(np.float32) if (x == x.astype(np.float32)).all() else x, np.zeros(0, np.int64))
    own = index.sample_list = index.own_list(x)
    subspaces = next(m for m in range(min(SUBSPACES, dims), 0, -1) if dims % m == 0)
    rest = (x - index.centre(own)).reshape(len(x), subspaces, -1)
    index.books = np.stack([kmeans(rest[:, m], min(CODES, len(x)), 6, rng) for m in range(subspaces)])
    q = np.unique(x, axis=0)
    q = q[rng.permutation(len(q))[: max(20, min(200, 100 * PLAN_SCORES // index.lists))]]
    exact = q @ x.T
    best = np.argsort(-exact, axis=1, kind="stable")[:, : k + 1]
    rest = np.stack([index.books[m][nearest(rest[:, m], index.books[m])] for m in range(subspaces)], axis=1).reshape(len(x), dims)
    decoded = index.centre(own) + rest
    short = np.take_along_axis(exact, best, axis=1) - np.einsum("qd,qnd->qn", q, decoded[best])
    index.margin = max(0.0, float((short / np.linalg.norm(q, axis=1)[:, None]).max()))
    order = index.order(q)
    where = np.empty_like(order)
    np.put_along_axis(where, order, np.broadcast_to(np.arange(index.lists), order.shape), axis=1)
    rank = np.take_along_axis(where, own[best], axis=1)  # the probe at which each true neighbour turns up
    while index.probes < index.lists and (rank < index.probes).mean() < target:
        index.probes = min(index.lists, index.probes + max(1, index.probes // 4))
    return index


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def search(vectors: DataFrame, is_query: Column, k: int = 20, index: Index | None = None, rerank: int = RERANK, block: int = BLOCK, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score: the k of vectors (vec_id, vector) nearest to each one for which is_query holds, itself excluded, by inner product.

    index, if given, is for vectors of its own length only.
    """
    good = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), "vector", is_query.alias("q"))
    lengths = [r[0] for r in good.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    out = None
    for n in lengths or [0]:
        fits = index if index and index.centroids.shape[1] == n else None
        part = _search(good.filter(F.size("vector") == n), k, fits, rerank, block, part_blocks)
        out = part if out is None else out.unionByName(part)
    return out


def _search(vectors: DataFrame, k: int, index: Index | None, rerank: int, block: int, part_blocks: int) -> DataFrame:
    spark = vectors.sparkSession
    stored = np.float32 if vectors.schema["vector"].dataType.simpleString() == "array<float>" else np.float64
    good = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    index = index or fit(good, k=k)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(index)  # COARSE_LISTS centroids at most, the residuals, the codebooks and the sample
    dims = index.centroids.shape[1]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one list: full ones as they fill, the rest at the end of the task."""
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        held: dict[int, int] = {}

        def packed(whose: int) -> pa.RecordBatch:
            ids, codes, x = (np.concatenate(p) for p in zip(*waiting.pop(whose), strict=True))
            held.pop(whose)
            by = np.argsort(ids, kind="stable")
            cut = [by[i : i + block] for i in range(0, len(by), block)]
            return pa.RecordBatch.from_arrays([pa.array([whose] * len(cut), pa.int32()), *[pa.array([_pack(a[c]) for c in cut], pa.binary()) for a in (ids, codes, x)]], ["list", "ids", "codes", "vectors"])

        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("vector"))
            own, codes = encode(shared.value, x)
            for whose in np.unique(own).tolist():
                at = np.flatnonzero(own == whose)
                waiting.setdefault(whose, []).append((ids[at], codes[at], x[at].astype(stored)))
                held[whose] = held.get(whose, 0) + len(at)
                if held[whose] >= block:
                    yield packed(whose)
        for whose in list(waiting):
            yield packed(whose)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of queries for each list they probe."""
        waiting: dict[int, list[tuple[int, np.ndarray, float]]] = {}

        def packed(whose: int) -> pa.RecordBatch:
            got = waiting.pop(whose)
            return pa.RecordBatch.from_arrays([pa.array([whose], pa.int32()), *[pa.array([_pack(np.array(column))], pa.binary()) for column in zip(*got, strict=True)]], ["list", "q_ids", "q_vectors", "floors"])

        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("vector"))
            step = max(8, min(256, PLAN_SCORES // shared.value.lists))
            for a in range(0, len(ids), step):
                probed, low = shared.value.plan(ids[a : a + step], x[a : a + step], k)
                yield from asked(ids[a : a + step], x[a : a + step], probed, low, waiting, packed)
                if sum(map(len, waiting.values())) >= WAITING:
                    yield from map(packed, list(waiting))
        yield from map(packed, list(waiting))

    def asked(ids: np.ndarray, x: np.ndarray, probed: np.ndarray, low: np.ndarray, waiting: dict, packed: Callable) -> Iterator[pa.RecordBatch]:
        for i, v, floor, row in zip(ids.tolist(), x, low, probed, strict=True):
            for whose in np.flatnonzero(row).tolist():
                got = waiting.setdefault(whose, [])
                got.append((i, v, floor[whose]))
                if len(got) >= QUERY_GROUP:
                    yield packed(whose)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], stored).reshape(-1, dims)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], np.float64).reshape(-1, dims)
                floor = np.frombuffer(row["floors"], np.float64)
                near = asymmetric(ix, row["list"], codes, q)
                near[q_ids[:, None] == ids[None, :]] = -np.inf
                met = promising(ix, q, near, floor, rerank * k)
                a, b = np.nonzero(met)
                score = np.einsum("pd,pd->p", q[a], x[b].astype(np.float64))
                use = np.flatnonzero(score >= floor[a])
                use = use[np.lexsort((ids[b[use]], -score[use], a[use]))]
                whose = a[use]
                use = use[np.arange(len(use)) - np.searchsorted(whose, whose) < k]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a[use]]), pa.array(ids[b[use]]), pa.array(score[use])], ["query_id", "vec_id", "score"])

    blocks = keep(good.select("vec_id", "vector").mapInArrow(indexed, "list int, ids binary, codes binary, vectors binary"), "index")
    probes = good.filter("q").select("vec_id", "vector").distinct().mapInArrow(probing, "list int, q_ids binary, q_vectors binary, floors binary")
    sizes = blocks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_blocks).cast("int").alias("parts"))  # a row for each list
    sizes = keep(sizes, "sizes")
    dealt = blocks.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).drop("parts")
    asking = probes.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = dealt.join(asking, ["list", "part"]).mapInArrow(scored, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
