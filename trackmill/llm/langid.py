"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: slot s holds a bitmask of the languages that have some
n-gram in s, so the AND over an n-gram's slots is the set of all languages that contain it, for one look-up.
A text's score for a language is the share of its n-grams in that language's set, less the share that false
positives alone would give.

Definitions at the edges: a null text, or one without letters, is `und` with score 0; a text with letters gets
a learned language always (ties and texts without any known n-gram: the smallest name among the best, score
possibly 0); without any labelled row every text is `und`. Repeated rows are judged alike, one output row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import chunked, forget, keep, mix64, sliced, without

#: Slots of a filter: SLOTS_EACH for each n-gram that some language has, as a power of two between these bounds (16 MB for each eight languages at most).
SLOT_BITS = (16, 24)
SLOTS_EACH = 8
HASHES = 3
ORDERS = (3, 4)
#: Bound of the labelled rows that the filters are fitted on, shared evenly among the languages.
FIT_ROWS = 24_000
#: An n-gram belongs to a language if it is seen there this often, and at this share of the rate it has in the language where it is commonest.
MIN_COUNT = 3
MIN_SHARE = 0.25
#: A text is of no learned language if its best score is no more than so many standard errors above what false positives give, told by so many n-grams at least.
CHANCE_Z = 3.0
MIN_GRAMS = 24

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter."""
    if not _letters:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isalpha():
                low = ch.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _letters.append(out)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of texts, the index of each one's text, and which texts have a letter.

    Words are runs of letters, lower-cased, with one space on each side; an n-gram keeps letters between its ends.
    """
    texts = [t or "" for t in texts]
    c = _letter_table()[np.frombuffer((" " + "  ".join(texts) + "   ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    size = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    is_letter = c != 32
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    has = np.zeros(len(texts), dtype=bool)
    inside = is_letter[: begin[-1]]
    has[owner[inside]] = True
    found, whose = [], []
    n = begin[-1] - max(ORDERS) + 1
    if n > 0:
        for order in ORDERS:
            ok = is_letter[1 : n + 1].copy()
            for j in range(2, order - 1):
                ok &= is_letter[j : n + j]
            at = np.flatnonzero(ok)
            whose.append(owner[at])
            key = np.full(len(at), order, dtype=np.uint64)
            for _ in range(order):
                key *= np.uint64(0x9E3779B97F4A7C15)
                key += c[at]
                at += 1
            found.append(mix64(key))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int32), has
    return np.concatenate(found), np.concatenate(whose), has


def slots(gram: np.ndarray, bits: int, hashes: int = HASHES) -> Iterator[np.ndarray]:
    """The gram's slots by each hash in turn."""
    low, step = gram & np.uint64(0xFFFFFFFF), (gram >> np.uint64(32)) | np.uint64(1)
    for _ in range(hashes):
        yield (low & np.uint64((1 << bits) - 1)).astype(np.int32)
        low += step


class Filters:
    """What fit() learns. masks: one row of slot bytes for each eight languages; false_rate: of each language."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.bits = masks.shape[1].bit_length() - 1
        fill = np.array([((masks[i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
        self.false_rate = fill**HASHES

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether that score is above chance, of each text."""
        langs, scores, above = [], [np.empty(0)], [np.empty(0, bool)]
        for a, b in chunked(texts):
            gram, owner, has = grams(texts[a:b])
            n, total = b - a, np.maximum(np.bincount(owner, minlength=b - a), 1).astype(float)
            rate = np.zeros((n, max(1, len(self.languages))))
            if len(gram):
                both = np.full((len(self.masks), len(gram)), 255, np.uint8)
                for at in slots(gram, self.bits):
                    for s, mask in enumerate(self.masks):
                        both[s] &= mask[at]
                del gram, at
                for i in range(len(self.languages)):
                    hits = np.bincount(owner[(both[i // 8] >> (i % 8)) & 1 == 1], minlength=n)
                    rate[:, i] = (hits / total - self.false_rate[i]) / max(1e-9, 1 - self.false_rate[i])
            best = rate.argmax(axis=1)
            known = has & bool(self.languages)
            langs += [self.languages[k] if ok else "und" for k, ok in zip(best, known)]
            score = np.where(known, np.clip(rate[np.arange(n), best], 0, 1), 0.0)
            chance = self.false_rate[best] if self.languages else np.zeros(n)
            scores.append(score)
            above.append(known & ((total < MIN_GRAMS) | (score * (1 - chance) > CHANCE_Z * np.sqrt((chance * (1 - chance) + 1 / total) / total))))
        return langs, np.concatenate(scores), np.concatenate(above)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            mine = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, b in chunked(mine):
                gram, n = np.unique(grams(mine[a:b])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, train: Column, fit_rows: int = FIT_ROWS, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE) -> Filters:
    """Filters from the rows of docs (doc_id, text, lang) for which train holds and lang is not null.

    fit_rows bounds those rows (in expectation; picked by a hash of doc_id, evenly by language); the driver gets
    the filter's slots, at most 2 ** SLOT_BITS[1], never the n-grams. A filter has SLOTS_EACH slots for each n-gram, so
    false positives stay rare however rich the languages are.
    """
    spark = docs.sparkSession
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(size)
    if not languages:
        return Filters([], np.zeros((0, 2), np.uint8))
    share = spark.createDataFrame([(x, i, min(1.0, fit_rows / len(languages) / size[x])) for i, x in enumerate(languages)], "lang string, lang_no int, part double")
    picked = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < F.col("part") * 1_000_000)
    counts = picked.select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(total), "lang").join(F.broadcast(share.select("lang", "lang_no")), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang_no", "n", "rate")).alias("all"))
    member = keep(top.select("gram", F.explode("all").alias("m"), "top").filter((F.col("m.n") >= min_count) & (F.col("m.rate") >= F.col("top") * min_share)).select("gram", F.col("m.lang_no").alias("lang_no")), "grams")
    bits = min(SLOT_BITS[1], max(SLOT_BITS[0], (SLOTS_EACH * member.select("gram").distinct().count()).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, lang = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for s in slots(gram, bits):
                yield pa.RecordBatch.from_arrays([pa.array((lang // 8).astype(np.int32)), pa.array(s), pa.array((1 << (lang % 8)).astype(np.int32))], ["slice", "slot", "bits"])

    filled = member.mapInArrow(placed, "slice int, slot int, bits int").groupBy("slice", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    masks = np.zeros(((len(languages) + 7) // 8, 1 << bits), np.uint8)
    masks[filled["slice"].to_numpy(), filled["slot"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint8)
    forget(member)
    return Filters(languages, masks)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text); only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 16 MB for each eight languages at most, whatever the input

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            langs, scores, _ = shared.value.judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """True where crc32 of the id leaves 2 modulo 4: rows that nothing is learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with all its columns, plus lang_pred, score and lang_known (columns of those names are replaced).

    lang_known: the score is above chance, or the text is too short to tell; false for `und`.
    """
    docs = without(docs, "lang_pred", "score", "lang_known")
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            langs, scores, known = shared.value.judge(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "lang_known"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lang_known", BooleanType())])
    return docs.mapInArrow(judged, schema)
