"""Plain, slow versions of what the operators compute, written from their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    w = SPACED.findall(low(text))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(docs):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    overlap = defaultdict(int)
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                overlap[ids[a], ids[b]] += 1
    for (a, b), n in overlap.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def windows(items):
    """window (words) -> item ids."""
    found = defaultdict(set)
    for name, text in items:
        w = ALNUM.findall(low(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            found[tuple(w[i : i + 10])].add(str(name))
    return found


def leaks(text, found):
    """n_words, n_hit, items of a text."""
    w = ALNUM.findall(low(text))
    hit, names = set(), set()
    for size in {len(k) for k in found}:
        for i in range(len(w) - size + 1):
            got = found.get(tuple(w[i : i + size]))
            if got:
                hit.update(range(i, i + size))
                names |= got
    return len(w), len(hit), sorted(names)


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def pii(text):
    found = []
    for k, (kind, pattern, ok) in enumerate(PII):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def phrases(text):
    """n_words, (start word, label) of each place."""
    w = ALNUM.findall(low(text))
    found = []
    for p, label in PHRASES.items():
        p = p.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def crc(text):
    return zlib.crc32((text or "").encode())
