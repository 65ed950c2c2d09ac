"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct shingle sets (documents with equal sets are one row, whatever their number), columns
are shingles. An entry of the product is the overlap of two rows: it is summed up from partial counts, one for each
block of columns, and that sum decides whether the rows link. Pairs whose sizes cannot give enough overlap are
discarded before: two sets of similarity t or more share one of the first n - ceil(t n) + 1 of their shingles under
any fixed order (here: by hash, with shingles that many sets have at the end), so only rows that meet in one of those
prefix columns are multiplied; then sizes too far apart, and a bound of the symmetric difference (the differing bits
of parity sketches: 1024 of them, then for large sets as many as they have shingles), discard most of the rest.

Blocks of rows are multiplied in an order that lets a group of near copies never make all its pairs:
1. each row with the smallest row of its prefix columns, the one that it shares most of them with;
2. each row with the smallest and the largest row of each column, where they are in different components;
3. columns that still hold rows of several components: sub-blocks of their rows with each other.
Together that tests every pair of rows that share a prefix column and are not linked through others already, which
gives the components. A link never leaves its component, so each document's links are counted there: sub-blocks of a
component's rows are multiplied with each other, and only each row's number of links leaves a product.

Definitions at the edges: a null or empty text, or one without words, has no shingles and is its own component; a
text of fewer than WORDS words is one shingle; a null id stays null in the result, names
no component, and a set that only such rows have is linked with nothing; repeated rows are equal sets. The links of
a row are all other rows with an id, equal sets included, that are similar enough. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunked, forget, keep, mix64, sliced

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
BLOCK_ROWS = 256
#: A set of more shingles than this is cut into blocks of columns.
BLOCK_SHINGLES = 4096
#: Sets that a task remembers so as not to describe them again; others may be described twice, which only costs time.
SEEN_SETS = 200_000
#: Sub-blocks in which links are counted hold about so many shingles, a set counting as LEAST_SHINGLES at least; so about 1,000 rows at most.
COUNT_SHINGLES = 512_000
LEAST_SHINGLES = 512
#: Up to so many ids (8 bytes each) are broadcast to pick the texts whose whole sets are needed; beyond, the texts are shuffled.
BROADCAST_IDS = 1_000_000
SKETCH_LONGS = 16
#: A shingle counts as frequent from so many sets on, or from more where over HEAVY_MAX (8 bytes each, broadcast) would; which ones do only matters for speed.
HEAVY_SETS = 8
HEAVY_MAX = 500_000
SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]

# Lower-cases A-Z and turns each separator (space, tab to carriage return) into a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    for a, b in chunked(texts):
        yield from _sets([(t or b"").translate(FOLD) for t in texts[a:b]], words)


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)  # each text between spaces
    is_word = raw != 32
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        yield from (np.empty(0, np.uint64) for _ in texts)
        return
    size = ends - starts
    inside = raw[is_word]
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, size)
    word = mix64(np.add.reduceat(_BYTE[inside] * _powers(int(size.max()))[place], first))
    begin = np.cumsum([1, *[len(t) + 1 for t in texts]])
    from_word = np.searchsorted(starts, begin)
    n = len(word) - words + 1
    gram = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(words if n > 0 else 0):
        gram += word[j : j + n] * _PLACE[j]
    gram = mix64(gram)
    for a, b in zip(from_word[:-1].tolist(), from_word[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(gram[a : b - words + 1])
        elif b > a:
            yield mix64(np.array([(word[a:b] * _PLACE[16 : 16 + b - a]).sum() + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.empty(0, np.uint64)


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the set's members in 64 * SKETCH_LONGS classes or the next power of two up to the set's size."""
    bits = 64 * SKETCH_LONGS
    while bits < len(found):
        bits *= 2
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(longs: np.ndarray, size: int = SKETCH_LONGS) -> np.ndarray:
    """The sketch of the same set in fewer classes."""
    while len(longs) > size:
        longs = longs[: len(longs) // 2] ^ longs[len(longs) // 2 :]
    return longs


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the sets' symmetric difference."""
    size = min(len(x), len(y))
    return int(np.bitwise_count((folded(x, size) ^ folded(y, size)).view(np.uint64)).sum())


def node_of(found: np.ndarray) -> int:
    """The hash that stands for a whole set."""
    return int(mix64(mix64(found ^ _BASE).sum(keepdims=True)).view(np.int64)[0])


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1


def prefix_of(found: np.ndarray, heavy: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a sorted set in the order that has those in heavy (sorted) at its end."""
    size = prefix_size(len(found), percent)
    for some in (found[: 2 * size], found):
        at = np.searchsorted(heavy, some)
        at[at == len(heavy)] = 0
        light = heavy[at] != some if len(heavy) else np.ones(len(some), bool)
        if light.sum() >= size:
            return some[light][:size]
    return np.concatenate((found[light], found[~light]))[:size]


def heavy_shingles(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, heavy_sets: int = HEAVY_SETS, heavy_max: int = HEAVY_MAX) -> np.ndarray:
    """Shingles among the first by hash of many sets, heavy_max of them at most."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            out = []
            for found in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words):
                if len(found) and (own := node_of(found)) not in seen:
                    if len(seen) < SEEN_SETS:
                        seen.add(own)
                    out.append(found[: prefix_size(len(found), percent)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out or [np.empty(0, np.uint64)]).view(np.int64))], ["h"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(firsts, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= heavy_sets)
    counts = keep(counts, "frequent")
    level = F.floor(F.log2("n"))
    least, held = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += r["count"]
        if held > heavy_max:
            break
        least = r["level"]
    found = np.empty(0, np.uint64)
    if least is not None:
        found = np.sort(counts.filter(level >= least).select("h").toArrow().column("h").to_numpy().view(np.uint64))
    forget(counts)
    return found


def incidence(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, heavy: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set, null if empty), and once per set and task its prefix columns, sketch, and longer sketch if it is large."""
    shared = docs.sparkSession.sparkContext.broadcast(np.empty(0, np.uint64) if heavy is None else heavy)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            n, node, prefix, bits, more = [], [], [], [], []
            for found in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words):
                n.append(len(found))
                own = node_of(found) if len(found) else None
                new = own is not None and own not in seen
                node.append(own)
                whole = sketch(found) if new else None
                prefix.append(prefix_of(found, shared.value, percent).view(np.int64) if new else None)
                bits.append(folded(whole) if new else None)
                more.append(whole.tobytes() if new and len(whole) > SKETCH_LONGS else None)
                if len(seen) < SEEN_SETS:
                    seen.add(own)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(prefix, longs), pa.array(bits, longs), pa.array(more, pa.binary())], ["doc_id", "n_shingles", "node", "prefix", "sketch", "more"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id long, n_shingles long, node long, prefix array<long>, sketch array<long>, more binary")


def level_of(n: Column) -> Column:
    """A set of n shingles is cut into 2 ** level blocks of columns."""
    over = F.floor((n - 1) / BLOCK_SHINGLES).cast("long")
    return F.when(over <= 0, 0).otherwise(F.length(F.bin(over))).cast("int")


def column_blocks(found: np.ndarray) -> list[np.ndarray]:
    """A sorted set by blocks of columns: those of equal leading bits of the hash."""
    level = ((len(found) - 1) // BLOCK_SHINGLES).bit_length()
    if not level:
        return [found]
    edges = np.arange(1, 1 << level, dtype=np.uint64) << np.uint64(64 - level)
    return np.split(found, np.searchsorted(found, edges))


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS, more: tuple[str, ...] = (), cut: bool = False) -> DataFrame:
    """node, the longs named by more, block and shingles (bytes) of the documents named by wanted (doc_id, node: one document for each set).

    cut: a row for each of column_blocks(); else all shingles in one row, of block 0.
    """
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("doc_id").alias("__id"), "node", *more)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__id")).select("node", *more, "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, block, sets = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for i, (own, found) in enumerate(zip(batch.column("node").to_pylist(), shingle_sets(texts, words), strict=True)):
                if len(found) and node_of(found) == own:  # else another text under the same id
                    parts = column_blocks(found) if cut else [found]
                    rows += [i] * len(parts)
                    block += range(len(parts))
                    sets += [p.tobytes() for p in parts]
            kept = batch.select(["node", *more]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(block, pa.int32()), pa.array(sets, pa.binary())], ["node", *more, "block", "shingles"])

    return texts.mapInArrow(made, ", ".join(f"{c} long" for c in ("node", *more)) + ", block int, shingles binary")


def may_link(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether the bounds from sizes and sketches leave the pair a chance; a and b prefix the columns n, s0, .."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(SKETCH_LONGS)), F.lit(0))
    # overlap <= (n + m - apart) / 2, and (100 + percent) * overlap >= percent * (n + m) is asked for
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & ((100 + percent) * (n + m - apart) >= 2 * percent * (n + m))


def linked(docs: DataFrame, pairs: DataFrame, briefs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) whose exact overlap suffices. briefs: node, doc_id, n and the sketch of each set.

    Bounds come first, from sizes and sketches; only the texts of sets that are left are read again. Their rows are cut
    into blocks of columns; each block of a pair gives a partial count, and the sum of those decides.
    """
    renamed = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    brief = briefs.select("node", "n", "more", *SKETCH)
    met = pairs.join(renamed(brief, "a_"), F.col("a") == F.col("a_node")).join(renamed(brief, "b_"), F.col("b") == F.col("b_node")).filter(may_link("a_", "b_", percent))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(sliced(batches, "a_more"), "b_more"):
            ok = []
            for x, n, y, m in zip(*(batch.column(c).to_pylist() for c in ("a_more", "a_n", "b_more", "b_n")), strict=True):
                gap = differing(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) if x and y else 0
                ok.append((100 + percent) * (n + m - gap) >= 2 * percent * (n + m))
            yield batch.select(["a", "b", "a_n", "b_n"]).filter(pa.array(ok, pa.bool_()))

    near = keep(met.select("a", "b", "a_n", "b_n", "a_more", "b_more").mapInArrow(bounded, "a long, b long, a_n long, b_n long"), "near")
    nodes = near.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = keep(briefs.select("node", "doc_id").filter(F.col("doc_id").isNotNull()).join(nodes, "node", "left_semi"), "wanted")
    sets = keep(whole_sets(docs, wanted, words, cut=True), "sets")
    whole = sets.dropDuplicates(["node", "block"])  # repeated rows
    # The block of fewer columns of either set lies within one of the other's, as sizes that may link are less than a level apart.
    level = near.withColumns({"__a": level_of(F.col("a_n")), "__b": level_of(F.col("b_n"))}).withColumn("__k", F.greatest("__a", "__b"))
    blocks = level.withColumn("__j", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, __k) - 1"))))
    blocks = blocks.select("a", "b", "a_n", "b_n", F.expr("shiftright(__j, __k - __a)").alias("a_at"), F.expr("shiftright(__j, __k - __b)").alias("b_at"))
    first, second = (whole.select(F.col("node").alias(f"{p}_node"), F.col("block").alias(f"{p}_block"), F.col("shingles").alias(f"{p}_shingles")) for p in "ab")
    both = blocks.join(first, (F.col("a") == F.col("a_node")) & (F.col("a_at") == F.col("a_block"))).join(second, (F.col("b") == F.col("b_node")) & (F.col("b_at") == F.col("b_block")))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("a_shingles"), batch.column("b_shingles"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) and len(q):
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    count[i] = (q[at] == p).sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "a_n", "b_n")), pa.array(count)], ["a", "b", "a_n", "b_n", "overlap"])

    partial = both.select("a", "b", "a_n", "b_n", "a_shingles", "b_shingles").mapInArrow(multiplied, "a long, b long, a_n long, b_n long, overlap long")
    summed = partial.groupBy("a", "b", "a_n", "b_n").agg(F.sum("overlap").alias("overlap"))
    links = keep(summed.filter((100 + percent) * F.col("overlap") >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b"), "links")
    forget(near, wanted, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of all nodes in links (a, b), by alternating large and small stars."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = keep(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, keep(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        forget(before, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    hubs = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(hubs.select("node", F.col("node").alias("label")))


def roots(links: DataFrame, jumps: int = 1) -> DataFrame:
    """node, label: a smaller node that each larger end of links is known to hang together with; not always the smallest."""
    own = up = keep(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "roots")
    for _ in range(jumps):
        above = up.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        up = up.join(above, F.col("label") == F.col("__n"), "left").select("node", F.coalesce("__l", "label").alias("label"))
    out = keep(up, "roots")
    forget(own)
    return out


def _labelled(rows: DataFrame, labels: DataFrame | None, node: str, into: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(into, F.col(node))
    return rows.join(labels.select(F.col("node").alias("__n"), F.col("label").alias("__l")), F.col(node) == F.col("__n"), "left").withColumn(into, F.coalesce("__l", node)).drop("__n", "__l")


def sub_blocks(rows: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """rows (key, node, n, ..), kept, plus own: the number of a sub-block inside key, of rows of like size that weigh about most together.

    Counts by key and size come from sums over all rows, and rows are dealt to sub-blocks by their hash, so no key is ever
    gathered in one place. A key that weighs no more than most is one sub-block.
    """
    scaled = rows.withColumn("__scale", F.floor(F.log2("n") * 3).cast("long"))
    sums = scaled.groupBy(key, "__scale").agg(F.sum(weight).alias("__w"))
    parts = sums.withColumn("__lone", F.sum("__w").over(Window.partitionBy(key)) <= most).select(key, "__scale", "__lone", F.ceil(F.col("__w") / most).alias("__parts"))
    own = F.when(F.col("__lone"), F.lit(0)).otherwise(F.col("__scale") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("__parts")))
    return keep(scaled.join(parts, [key, "__scale"]).withColumn("own", own.cast("long")).drop("__scale", "__lone", "__parts"), "placed")


def meeting(placed: DataFrame, key: str, percent: int = PERCENT) -> DataFrame:
    """key, i, j (i <= j): sub-blocks whose sizes allow links between them."""
    span = placed.groupBy(key, F.col("own").alias("i")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = span.select(F.col(key).alias("__key"), F.col("i").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = (F.col("lo2") * percent <= F.col("hi") * 100) & (F.col("lo") * percent <= F.col("hi2") * 100)
    return span.join(other, (F.col(key) == F.col("__key")) & (F.col("j") >= F.col("i")) & near).select(key, "i", "j")


def rest_pairs(blocks: DataFrame, briefs: DataFrame, block_rows: int = BLOCK_ROWS, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) inside the same column that are in different components (label) and pass the bounds, by sub-blocks."""
    placed = sub_blocks(blocks.join(briefs.drop("doc_id", "more"), "node"), "h", F.lit(1), block_rows)
    meets = meeting(placed, "h", percent)
    named = ("node", "label", "n", *SKETCH)
    left = placed.withColumnRenamed("own", "i").join(meets, ["h", "i"]).select("h", "i", "j", *[F.col(c).alias(f"a_{c}") for c in named])
    right = placed.withColumnRenamed("own", "j").join(meets, ["h", "j"]).select("h", "i", "j", *[F.col(c).alias(f"b_{c}") for c in named])
    ok = (F.col("a_label") != F.col("b_label")) & ((F.col("i") != F.col("j")) | (F.col("a_node") < F.col("b_node"))) & may_link("a_", "b_", percent)
    met = left.join(right, ["h", "i", "j"]).filter(ok)
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def overlaps(sets: list[np.ndarray], split: int, often: int = 32, width: int = 1024) -> np.ndarray:
    """Overlaps of each of sets[:split] with each of sets[split:], or of all with all where split is their number; a set's own does not count."""
    whole = split == len(sets)
    begin = 0 if whole else split
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((split, len(sets) - begin), dtype=np.int64)
    dense = times[col] >= often
    # Shingles of few sets: each entry with the next ones of its column.
    r, c = row[~dense], col[~dense]
    order = np.lexsort((r, c))
    r, c = r[order], c[order]
    for d in range(1, often):
        alike = c[d:] == c[:-d]
        if not alike.any():
            break
        x, y = r[:-d][alike], r[d:][alike]
        across = (x < split) & (y >= begin)
        np.add.at(out, (x[across], y[across] - begin), 1)
    if whole:
        out += out.T
    # Shingles of many sets: dense products of width columns, exact in float32.
    r, c = row[dense], (np.cumsum(times >= often) - 1)[col[dense]]
    for at in range(0, int((times >= often).sum()), width):
        some = (c >= at) & (c < at + width)
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[r[some], c[some] - at] = 1
        out += (part[:split] @ part[begin:].T).astype(np.int64)
    if whole:
        np.fill_diagonal(out, 0)
    return out


def sums_of_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int) -> np.ndarray:
    """For each set of left, then right (rows and shingles), the rows in linked sets of the other side; or of left itself if right is empty."""
    both = left + right
    weight, n = np.array([w for w, _ in both]), np.array([len(s) for _, s in both])
    split, begin = len(left), len(left) if right else 0
    ok = ((100 + percent) * overlaps([s for _, s in both], split) >= percent * (n[:split, None] + n[None, begin:])).astype(np.float64)
    return np.concatenate((ok @ weight[begin:], weight[:split] @ ok if right else [])).astype(np.int64)


def link_counts(docs: DataFrame, members: DataFrame, words: int = WORDS, percent: int = PERCENT, shingles: int = COUNT_SHINGLES) -> DataFrame:
    """node, n_linked: rows in the sets linked with that of node. members: node, doc_id, n, weight (rows) and label (component) of each set.

    Sub-blocks are parts of a component of like size, dealt by hash; each product of two is a group of rows of its own.
    """
    rows = members.select("node", "doc_id", "label", "n", "weight")
    placed = sub_blocks(rows, "label", F.greatest("n", F.lit(LEAST_SHINGLES)), shingles)
    meets = meeting(placed, "label", percent)
    sides = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    roles = keep(meets.select(F.col("label").alias("__l"), "i", "j", F.explode(sides).alias("__own")), "roles")
    sets = whole_sets(docs, placed, words, ("label", "own", "weight"))
    rows = sets.join(roles, (F.col("label") == F.col("__l")) & (F.col("own") == F.col("__own"))).select("label", "i", "j", (F.col("own") != F.col("i")).alias("second"), "node", "weight", "shingles")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, ({}, {})  # by node, as rows may be repeated

        def sums() -> pa.RecordBatch:
            left, right = (list(side.values()) for side in group)
            found = sums_of_links(left, right, percent) if len(left) + len(right) > 1 else np.zeros(len(left) + len(right), np.int64)
            return pa.RecordBatch.from_arrays([pa.array([*group[0], *group[1]], pa.int64()), pa.array(found, pa.int64())], ["node", "n"])

        for batch in sliced(batches, "shingles"):
            for *key, second, node, weight, raw in zip(*(batch.column(c).to_pylist() for c in ("label", "i", "j", "second", "node", "weight", "shingles")), strict=True):
                if key != at:
                    yield sums()
                    at, group = key, ({}, {})
                group[second][node] = (weight, np.frombuffer(raw, np.uint64))
        yield sums()

    key = ("label", "i", "j")
    partial = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(counted, "node long, n long")
    out = keep(partial.groupBy("node").agg(F.sum("n").alias("n_linked")), "counts")
    forget(placed, roles)
    return out


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, if count, n_links of each of docs (doc_id, text)."""
    rows = keep(incidence(docs, words, percent, heavy_shingles(docs, words, percent)), "incidence")
    columns = rows.filter(F.col("prefix").isNotNull()).select("node", F.explode("prefix").alias("h"))
    # Sums by shingle, then a plain join, whose large partitions Spark can split: a window would gather each shingle's rows.
    ends = columns.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    blocks = keep(columns.join(ends, "h"), "blocks")
    sketches = [F.element_at("sketch", i + 1).alias(c) for i, c in enumerate(SKETCH)]
    once = [F.first(c, ignorenulls=True).alias(c) for c in ("sketch", "more")]
    classes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("doc_id").alias("weight"), *once)
    classes = keep(classes.select("node", "doc_id", "n", "weight", "more", *sketches), "classes")
    briefs = keep(classes.drop("weight").join(blocks.select("node"), "node", "left_semi"), "briefs")

    # The smaller row that most of a row's blocks begin with.
    below = blocks.filter("lo < node").groupBy("node", "lo").agg(F.count(F.lit(1)).alias("k"))
    first = below.groupBy("node").agg(F.max_by("lo", F.struct("k", "lo")).alias("a")).select("a", F.col("node").alias("b"))
    first_links = linked(docs, first, briefs, words, percent)
    known = roots(first_links)

    pairs = blocks.select(F.col("lo").alias("a"), F.col("node").alias("b")).union(blocks.select(F.col("node").alias("a"), F.col("hi").alias("b"))).filter("a < b").distinct()
    apart = _labelled(_labelled(pairs, known, "a", "la"), known, "b", "lb").filter("la != lb").select("a", "b")
    links = keep(first_links.union(linked(docs, apart, briefs, words, percent)), "links")
    labels = keep(components(links), "labels")

    inner = _labelled(blocks.filter("node != lo AND node != hi").select("h", "node").distinct(), labels, "node", "label")
    mixed = inner.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("h")
    left_over = keep(inner.join(mixed, "h", "left_semi"), "rest")
    if not left_over.isEmpty():
        last = linked(docs, rest_pairs(left_over, briefs, percent=percent), briefs, words, percent)
        if not last.isEmpty():
            labels = keep(components(links.union(last)), "labels")
    forget(blocks, briefs, known, left_over)

    named = _labelled(classes.select("node", "doc_id", "weight"), labels, "node", "label")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(smallest, "label").select(F.col("node").alias("__node"), "component_id", "weight")
    out = rows.select("doc_id", "n_shingles", "node").join(of_node, F.col("node") == F.col("__node"), "left")
    shown = ["doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")]
    if not count:
        return out.select(*shown)
    members = classes.select("node", "doc_id", "n", "weight").join(labels, "node")
    linked_with = link_counts(docs, members, words, percent).withColumnRenamed("node", "__linked")
    own = F.coalesce("weight", F.lit(0)) - F.when(F.col("node").isNotNull() & F.col("doc_id").isNotNull(), 1).otherwise(0)
    return out.join(linked_with, F.col("node") == F.col("__linked"), "left").select(*shown, (own + F.coalesce("n_linked", F.lit(0))).alias("n_links"))
