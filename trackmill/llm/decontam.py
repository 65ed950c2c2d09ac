"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton holds every run of words of every item. A text's words stream through it; at each word the state
gives the longest run of item words that ends there, so a window of WINDOW item words (or a whole shorter item)
has been seen exactly if that length reaches the window's. Words between two words that no item has cannot be part
of a run, so only stretches of item words walk the automaton.

Items go in blocks of BLOCK_WORDS words at most (or one longer item), one automaton each. One block at a time is
built on the driver (about 1 KB a word), packed into arrays (under 100 bytes a word), travels so to the tasks and meets
the texts, so memory is that of a block whatever the benchmark's size. Of a benchmark of several blocks, the hashes of all
windows (8 bytes each, and the different words) travel first: one scan of the texts finds those that hold some window, and
only they meet the blocks. What all blocks found in a text is put together before anything is decided about it.

Definitions at the edges: a null text or item has no words and no hits; an item without words matches nothing;
repeated items are reported each by its id; repeated rows are judged alike; null item ids are left out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, mix64, sliced

WINDOW = 10
BLOCK_WORDS = 100_000

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower-cases A-Z and turns every other ASCII character but digits and letters into a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 32 for b in range(256))


def words(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.names = [name for name, _ in coded]
        self.shortest = min((min(len(s), window) for _, s in coded), default=0)
        self._report(coded)
        self._pack()

    def _clone(self, p: int, w: int, q: int) -> int:
        """A copy of q for runs as short as p's and one word more."""
        new = len(self.size)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, w: int) -> int:
        q = self.step[last].get(w)
        if q is not None:  # an earlier item has this run
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, w, q)
        new = len(self.size)
        self.step.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, w, q)
        return new

    def _report(self, coded: list[tuple[str, list[int]]]) -> None:
        """ends: of each state, the windows that end when it is reached: (length, items), from its suffixes."""
        own: dict[int, tuple[int, set[int]]] = {}
        for k, (_, seq) in enumerate(coded):
            need, state = min(len(seq), self.window), 0
            for i, w in enumerate(seq):
                state = self.step[state][w]
                if i + 1 >= need:
                    at = state
                    while self.size[self.link[at]] >= need:
                        at = self.link[at]
                    own.setdefault((at, need), set()).add(k)
        by_state: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for (at, need), items in own.items():
            by_state.setdefault(at, []).append((need, tuple(sorted(items))))
        self.ends: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.size)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.ends[s] = self.ends[self.link[s]] + tuple(sorted(by_state.get(s, ())))

    def _pack(self) -> None:
        """States as arrays: most have one next word, and windows of one length; only the others stay in dictionaries."""
        width = len(self.ids)
        self.next_word, self.next_state = array("i", [-1]) * len(self.size), array("i", [-1]) * len(self.size)
        self.more: dict[int, int] = {}
        for s, step in enumerate(self.step):
            if len(step) == 1:
                ((self.next_word[s], self.next_state[s]),) = step.items()
            elif step:
                self.next_word[s] = -2
                self.more |= {s * width + w: to for w, to in step.items()}
        need, begin, whose, odd = array("i"), array("i", [0]), array("i"), {}
        for s, ends in enumerate(self.ends):
            need.append(ends[0][0] if len(ends) == 1 else -1 if ends else 0)
            if len(ends) == 1:
                whose.extend(ends[0][1])
            elif ends:
                odd[s] = ends
            begin.append(len(whose))
        self.need, self.begin, self.whose, self.odd = need, begin, whose, odd
        self.link, self.size = array("i", self.link), array("i", self.size)
        del self.step, self.ends

    def windows_at(self, s: int) -> Sequence[tuple[int, Sequence[int]]]:
        """The windows that end when state s is reached."""
        need = self.need[s]
        return () if not need else self.odd[s] if need < 0 else ((need, self.whose[self.begin[s] : self.begin[s + 1]]),)

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words hit (begin, end exclusive; merged, in order) and the items whose windows occur."""
        found: list[list[int]] = []
        items: set[int] = set()
        if not self.shortest or len(ws) < self.shortest:
            return [], items
        code = np.fromiter((-1 if (c := self.ids.get(w)) is None else c for w in ws), dtype=np.int64, count=len(ws))
        next_word, next_state, more, width, link, size, needs = self.next_word, self.next_state, self.more, len(self.ids), self.link, self.size, self.need
        known = np.concatenate(([False], code >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, b in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2)).ravel() >= self.shortest].tolist():
            state = length = 0
            for i, w in enumerate(code[a:b].tolist(), a):
                while True:
                    only = next_word[state]
                    to = next_state[state] if only == w else more.get(state * width + w, -1) if only == -2 else -1
                    if to >= 0 or not state:
                        break
                    state = link[state]
                    length = size[state]
                if to < 0:
                    continue
                state, length = to, length + 1
                for need, whose in self.windows_at(state) if needs[state] else ():
                    if need > length:
                        continue
                    items.update(whose)
                    if found and i + 1 - need <= found[-1][1]:
                        found[-1] = [min(found[-1][0], i + 1 - need), i + 1]
                        while len(found) > 1 and found[-2][1] >= found[-1][0]:
                            last = found.pop()
                            found[-1] = [min(found[-1][0], last[0]), last[1]]
                    else:
                        found.append([i + 1 - need, i + 1])
        return [(a, b) for a, b in found], items


class Sieve:
    """Hashes of all windows of several blocks of items: whether a text can hold any of them."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.found: dict[int, set[int] | np.ndarray] = {}

    def add(self, items: Sequence[tuple[str, list[bytes]]]) -> None:
        for _, ws in items:
            if ws:
                n = min(len(ws), self.window)
                self.found.setdefault(n, set()).update(self._hashes(np.array([self.ids.setdefault(w, len(self.ids)) for w in ws], np.int64), n).tolist())

    def packed(self) -> Sieve:
        self.found = {n: np.array(sorted(h), np.uint64) for n, h in self.found.items()}
        return self

    @staticmethod
    def _hashes(code: np.ndarray, n: int) -> np.ndarray:
        c = mix64(code.astype(np.uint64) + np.uint64(1))
        out = np.zeros(len(c) - n + 1, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - n + 1 + i]
        return out

    def holds(self, ws: list[bytes]) -> bool:
        """Whether a window's hash occurs in the words; none that has a window is missed."""
        code = np.fromiter((self.ids.get(w, -1) for w in ws), np.int64, len(ws))
        known = np.concatenate(([0], np.cumsum(code >= 0)))
        for n, hashes in self.found.items():
            if len(ws) >= n:
                at = np.flatnonzero(known[n:] - known[:-n] == n)
                if len(at) and len(hashes):
                    own = self._hashes(code, n)[at]
                    if (hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own).any():
                        return True
        return False


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Blocks of items (name, words) of benchmark (item_id, text); one at least, which may be empty."""
    block: list[tuple[str, list[bytes]]] = []
    used, made = 0, False
    rows = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).orderBy("item_id")
    for r in rows.toLocalIterator():
        ws = words(bytes(r["text"]) if r["text"] is not None else None)
        if used and used + len(ws) > block_words:
            yield block
            block, used, made = [], 0, True
        block.append((r["item_id"], ws))
        used += len(ws)
    if block or not made:
        yield block


def sieve(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[Automaton | None, Sieve | None]:
    """The automaton of a benchmark of one block, or the sieve of one of several."""
    blocks = item_blocks(benchmark, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return Automaton(first, window), None
    out = Sieve(window)
    for block in (first, second):
        out.add(block)
    for block in blocks:
        out.add(block)
    return None, out.packed()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def check_words(ws: list[bytes], blocks: list[Automaton]) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans hit and items seen over all blocks."""
    spans, items = [], set()
    for a in blocks:
        got, seen = a.hits(ws)
        spans += got
        items.update(a.names[k] for k in seen)
    return merged(spans) if len(blocks) > 1 else spans, sorted(items)


MATCH = "doc_id long, n_words long, n_hit long, spans array<struct<begin:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (in words) and items of each of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one, several = sieve(benchmark, window, block_words)
    if one is not None:
        shared = docs.sparkSession.sparkContext.broadcast(one)

        def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                size, hit, spans, items = [], [], [], []
                for raw in batch.column("text").cast(pa.binary()).to_pylist():
                    ws = words(raw)
                    got, seen = check_words(ws, [shared.value])
                    size.append(len(ws))
                    hit.append(sum(b - a for a, b in got))
                    spans.append([{"begin": a, "end": b} for a, b in got])
                    items.append(seen)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "spans", "items"])

        return rows.mapInArrow(matched, MATCH)

    flagged = sieved(rows, several)
    hits = _hits(flagged.filter("__maybe").select("__row", "text"), benchmark, window, block_words)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(x["begin"], x["end"]) for x in a or ()]) for a in batch.column("spans").to_pylist()]
            items = [sorted(set(a or ())) for a in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__words"), pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], _SPANS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "spans", "items"])

    return flagged.drop("text").join(hits, "__row", "left").select("doc_id", "__words", "spans", "items").mapInArrow(joined, MATCH)


def sieved(rows: DataFrame, several: Sieve) -> DataFrame:
    """rows, kept, with __words, whether a text may hold a window (__maybe), and a number of the row (__row)."""
    shared = rows.sparkSession.sparkContext.broadcast(several)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [(len(ws), shared.value.holds(ws)) for raw in batch.column("text").cast(pa.binary()).to_pylist() for ws in [words(raw)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], pa.bool_())], [*batch.schema.names, "__words", "__maybe"])

    schema = T.StructType([*rows.schema, T.StructField("__words", T.LongType()), T.StructField("__maybe", T.BooleanType())])
    return keep(rows.mapInArrow(judged, schema).withColumn("__row", F.monotonically_increasing_id()), "sieved")


def _hits(some: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """__row, spans and items that any block finds in some (__row, text); rows without are left out."""
    out = None
    for block in item_blocks(benchmark, block_words):
        shared = some.sparkSession.sparkContext.broadcast(Automaton(block, window))

        def matched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                found = [check_words(words(raw), [shared.value]) for raw in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array([[{"begin": a, "end": b} for a, b in got] for got, _ in found], _SPANS), pa.array([seen for _, seen in found], pa.list_(pa.string()))], ["__row", "spans", "items"])

        part = keep(some.mapInArrow(matched, "__row long, spans array<struct<begin:int,end:int>>, items array<string>").filter(F.size("items") > 0), "hits")
        shared.destroy()
        out = part if out is None else out.union(part)
    # A row's hits over all blocks are of its own size at most.
    return out.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def cut_out(raw: bytes, spans: Sequence[tuple[int, int]], max_words: int, max_share: float) -> bytes | None:
    """raw without the spans (in words) of more than max_words words, or None if all spans make up more than max_share of its words."""
    folded = raw.translate(FOLD)
    n = len(folded.split())
    if n and sum(b - a for a, b in spans) > max_share * n:
        return None
    spans = [(a, b) for a, b in spans if b - a > max_words]
    if not spans:
        return raw
    flags = np.frombuffer(b" " + folded, np.uint8) != 32
    starts = np.flatnonzero(flags[1:] & ~flags[:-1])
    ends = np.flatnonzero(flags[1:] & ~np.append(flags[2:], False)) + 1
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b" ".join([*parts, raw[at:]])


def cleaned(raw: bytes, blocks: list[Automaton], max_words: int, max_share: float) -> bytes | None:
    """cut_out() until nothing more is cut: what is joined may match anew."""
    while True:
        spans, _ = check_words(words(raw), blocks)
        new = cut_out(raw, spans, max_words, max_share)
        if new is None or new == raw:
            return new
        raw = new


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = 0, max_share: float = 1.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with all columns, matched spans of more than max_words words cut out of text, and rows gone whose spans cover more than max_share of their words.

    A text is checked again after each cut, since what is joined may match anew. The number of blocks changes nothing in
    the result: the spans of all blocks are put together first.
    """
    one, several = sieve(benchmark, window, block_words)
    if one is not None:
        shared = docs.sparkSession.sparkContext.broadcast(one)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                k = batch.schema.get_field_index("text")
                out = [(i, None if raw is None else cleaned(raw, [shared.value], max_words, max_share), raw is None) for i, raw in enumerate(batch.column(k).cast(pa.binary()).to_pylist())]
                found = [(i, t) for i, t, null in out if t is not None or null]
                kept = batch.take(pa.array([i for i, _ in found], pa.int64()))
                arrays = list(kept.columns)
                arrays[k] = pa.array([t for _, t in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, kept.schema.names)

        return docs.mapInArrow(cut, docs.schema)

    flagged = sieved(docs, several)
    todo, ended = flagged.filter("__maybe").select("__row", "text"), None

    def cut_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, new, gone = [], [], []
            for row, raw, spans in zip(batch.column("__row").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = cut_out(raw, merged([(x["begin"], x["end"]) for x in spans]), max_words, max_share)
                if text != raw:
                    rows.append(row)
                    new.append(text)
                    gone.append(text is None)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(new, pa.binary()).cast(pa.string()), pa.array(gone, pa.bool_())], ["__row", "text", "gone"])

    number = 0
    while True:
        hits = _hits(todo, benchmark, window, block_words)
        now = keep(todo.join(hits.select("__row", "spans"), "__row").mapInArrow(cut_once, "__row long, text string, gone boolean"), "cut")
        if now.isEmpty():
            break
        some = now.withColumn("round", F.lit(number))
        ended = some if ended is None else ended.unionByName(some)
        todo, number = now.filter("NOT gone").select("__row", "text"), number + 1
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if ended is None:
        return flagged.select(*columns)
    last = ended.groupBy("__row").agg(F.max_by(F.struct("text", "gone"), "round").alias("__last"))
    name = next(c for c in docs.columns if c.lower() == "text")
    some = flagged.filter("__maybe").join(last, "__row", "left").filter("__last IS NULL OR NOT __last.gone")
    some = some.withColumn(name, F.coalesce("__last.text", F.col(f"`{name}`")))
    return flagged.filter("NOT __maybe").select(*columns).unionByName(some.select(*columns))
