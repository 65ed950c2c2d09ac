"""License scans: exact phrases, and short notices found with bounded errors.

A notice of k allowed errors is split into k + 1 pieces: whatever k edits do, one piece stays as it is. All pieces
of all notices go into one Aho-Corasick automaton; a text in which a piece is found is a candidate around that
place only, and there the regex library's bounded-error matching verifies the notice and reports its span: the best
one of a stretch first, then those left and right of it.
Work and memory are per text: no row depends on another.

Definitions at the edges: a null text is empty; a text without words has no places; one span is reported for each
notice and place (overlapping candidates of a notice merge); repeated rows are judged alike.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

# The phrases that count word by word, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices: label, text in lower case, edits allowed.
NOTICES = (
    ("mit", "permission is hereby granted, free of charge, to any person", 4),
    ("mit", "released under the mit license", 2),
    ("apache-2", "licensed under the apache license, version 2.0", 3),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("gpl", "under the terms of the gnu general public license", 4),
    ("mpl-2", "subject to the terms of the mozilla public license", 4),
    ("cc-by-nc", "creative commons attribution-noncommercial", 3),
    ("cc-by-sa", "creative commons attribution-sharealike", 3),
    ("proprietary", "all rights reserved", 1),
)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def phrase_pattern(phrases: dict[str, str]) -> re.Pattern[bytes]:
    """All phrases as whole words with anything but words between them, in lower-cased UTF-8."""
    gap, edge = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", rb"[0-9a-z\x80-\xff]"
    one = [b"(" + gap.join(re.escape(w.encode()) for w in p.split()) + b")" for p in phrases]
    return re.compile(b"(?<!" + edge + b")(?:" + b"|".join(one) + b")(?!" + edge + b")")


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """text split evenly into errors + 1 pieces, each with its offset."""
    cut = [len(text) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: tuple[tuple[str, str, int], ...] = NOTICES):
        import ahocorasick
        import regex

        self.labels, self.phrase, self.notices = list(phrases.values()), phrase_pattern(phrases), notices
        self.first = re.compile(rb"license|cc[\x00-\x2f\x3a-\x60\x7b-\x7f]") if phrases == PHRASES else None
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(notices):
            for at, piece in pieces(text, errors):
                seeds.setdefault(piece, []).append((n, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(text, special_only=True)}){{e<={errors}}}") for _, text, errors in notices]

    def words(self, low: bytes) -> np.ndarray:
        """Where each word starts in lower-cased UTF-8."""
        is_word = _WORD[np.frombuffer(low, dtype=np.uint8)]
        is_start = is_word.copy()
        is_start[1:] &= ~is_word[:-1]
        return np.flatnonzero(is_start)

    def base(self, low: bytes) -> list[tuple[int, str]]:
        """Byte offset and label of each place of a phrase."""
        if self.first and not self.first.search(low):
            return []
        return [(m.start(), self.labels[m.lastindex - 1]) for m in self.phrase.finditer(low)]

    def best_first(self, low: str, begin: int, end: int, n: int) -> list:
        """Matches of notice n in a stretch that do not overlap: the best first (ties: the leftmost), then the best of what it leaves, and so on.

        A long stretch is searched in windows that overlap by a match's length; a match found makes only the windows it
        touches be searched again, so time is in proportion to the stretch.
        """
        reach = len(self.notices[n][1]) + self.notices[n][2]
        step = 3 * reach if end - begin > 6 * reach else end - begin
        count = max(1, -(-(end - begin) // max(1, step)))
        taken: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        heap: list[tuple[int, int, int, int, object]] = []
        version = [0] * count

        def look(k: int) -> None:
            """The best match of window k beside what is taken there."""
            version[k] += 1
            at, stop = begin + k * step, min(end, begin + (k + 1) * step + reach)
            best = None
            for a, b in [*sorted(taken[k]), (stop, stop)]:
                if a > at and (m := self.fuzzy[n].search(low, at, min(a, stop))) and (best is None or sum(m.fuzzy_counts) < sum(best.fuzzy_counts)):
                    best = m
                at = max(at, b)
            if best:
                heapq.heappush(heap, (sum(best.fuzzy_counts), best.start(), k, version[k], best))

        for k in range(count):
            look(k)
        out = []
        while heap:
            _, _, k, seen, m = heapq.heappop(heap)
            if seen != version[k]:
                continue
            out.append(m)
            touched = [j for j in range(max(0, k - 2), min(count, k + 3)) if begin + j * step < m.end() and m.start() < begin + (j + 1) * step + reach]
            for j in touched:
                taken[j].append((m.start(), m.end()))
            for j in touched:
                look(j)
        return out

    def spans(self, low: str) -> list[tuple[int, int, str, float]]:
        """begin, end, label and score of each notice found with its errors or fewer."""
        near: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.seeds.iter(low):
            for n, at in where:
                _, text, errors = self.notices[n]
                a, b = max(0, end + 1 - size - at - errors), min(len(low), end + 1 - size - at + len(text) + errors)
                stretch = near.setdefault(n, [])
                if stretch and a <= stretch[-1][1]:
                    stretch[-1] = [min(a, stretch[-1][0]), max(b, stretch[-1][1])]
                else:
                    stretch.append([a, b])
        found = []
        for n, stretch in near.items():
            label, text, _ = self.notices[n]
            for a, b in stretch:
                found += [(m.start(), m.end(), label, 1 - sum(m.fuzzy_counts) / len(text)) for m in self.best_first(low, a, b, n)]
        return sorted(found)


SCAN_SCHEMA = "doc_id long, n_words long, base array<struct<word:bigint,label:string>>, spans array<struct<begin:bigint,end:bigint,label:string,score:double>>"


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> DataFrame:
    """Of each of docs (doc_id, text): n_words, base (places of phrases, in words) and spans (notices, in code points)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        kinds = [pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))]
        for batch in sliced(batches):
            count, base, spans = [], [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                low = (raw or b"").lower()
                starts = scanner.words(low)
                count.append(len(starts))
                base.append([{"word": int(np.searchsorted(starts, at)), "label": x} for at, x in scanner.base(low)])
                spans.append([dict(zip(("begin", "end", "label", "score"), s, strict=True)) for s in scanner.spans(low.decode("utf-8", "replace"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(base, kinds[0]), pa.array(spans, kinds[1])], ["doc_id", "n_words", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scanned, SCAN_SCHEMA)
