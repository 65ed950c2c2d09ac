"""Each operator against its plain version in brute.py, on hand-made rows with the awkward cases."""

from __future__ import annotations

import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.llm import ann, chat, credentials, decontam, jaccard, langid, licenses, mixing, negatives, pii, repair, shards, urltree

from . import brute

DOCS = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def awkward(seed=1):
    """Nulls, empties, copies, near copies, a very long text, shared passages and odd characters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(40))
    base = [word() for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "ONE\ttwo"), (5, "a b c d e"), (6, "A b\nc d e"), (7, "a b c d e f"), (8, "éa ß日本 𝒳 x y z w v"), (9, LONG), (10, LONG)]
    for i in range(30):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(120)] = word()
        rows.append((20 + i, " ".join(copy)))
    for i in range(30):
        rows.append((60 + i, " ".join(word() for _ in range(60)) + " " + passage + " " + " ".join(word() for _ in range(60))))
    rows += [(100 + i, "same text for all of these rows here") for i in range(40)]
    return rows


def test_jaccard_equals_brute_force(spark):
    rows = awkward()
    docs = frame(spark, rows).withColumns({"node": F.lit(1), "h": F.lit("x")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_rest_of_large_blocks(spark):
    """Groups that share columns without being similar to the first or last of their block."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(12)]
    rows = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(40)]
        for c in range(4):
            copy = list(own)
            copy[rng.randrange(30)] = f"v{g}{c}"
            rows.append((g * 10 + c, " ".join(shared + copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_of_long_texts_by_blocks_of_columns(spark):
    """Sets of one, two, four and eight blocks of columns, some linked across a change of that number, some just not."""
    words = [f"w{i}" for i in range(20_000)]
    cuts = (20_000, 18_000, 16_100, 16_300, 12_000, 8_300, 8_100, 6_700, 4_200, 4_050, 3_300, 3_000)
    rows = [(i, " ".join(words[:n])) for i, n in enumerate(cuts)] + [(50 + i, " ".join(words[9_000 : 9_000 + n])) for i, n in enumerate((4_300, 4_000, 3_600))]
    found = jaccard.join(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.jaccard(rows)
    sets = {i: brute.shingles(t) for i, t in rows}
    assert {r.doc_id: r.n_links for r in found} == {i: sum(100 * len(x & y) >= 80 * len(x | y) for j, y in sets.items() if j != i) for i, x in sets.items()}


def test_jaccard_small_blocks_of_rows_agree(spark):
    rows = awkward(3)
    docs = frame(spark, rows)
    found = jaccard.incidence(docs)
    shared = found.filter("prefix IS NOT NULL").select("node", F.explode("prefix").alias("h"))
    briefs = found.filter("sketch IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "doc_id", *[F.element_at("sketch", i + 1).alias(c) for i, c in enumerate(jaccard.SKETCH)]).dropDuplicates(["node"])
    blocks = shared.distinct().withColumn("label", F.col("node"))
    pairs = [{(r.a, r.b) for r in jaccard.rest_pairs(blocks, briefs, n).collect()} for n in (2, 7, 1000)]
    assert pairs[0] == pairs[1] == pairs[2]


def test_jaccard_empty_and_repeated(spark):
    assert jaccard.join(frame(spark, [])).count() == 0
    got = jaccard.join(frame(spark, [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (5, None)])).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in got) == [(False, 0, 5), (False, 3, 5), (False, 3, 5), (True, 3, 5)]


def test_jaccard_counts_links_inside_components(spark):
    """Near copies in one group, some of them linked through others only, and equal sets."""
    base = [f"w{i}" for i in range(64)]
    rows = awkward(4) + [(200 + i, " ".join([*base[:i], *(f"{k}x{i}" for k in range(3)), *base[i + 3 :]])) for i in range(0, 60, 3)] + [(300 + i, " ".join(base)) for i in range(3)]
    sets = {i: brute.shingles(t) for i, t in rows}
    links = {i: sum(100 * len(x & y) >= 80 * len(x | y) for j, y in sets.items() if i != j and x and y) for i, x in sets.items()}
    docs = frame(spark, rows)
    got = {r.doc_id: r.n_links for r in jaccard.join(docs).collect()}
    assert got == links and max(links.values()) > 20
    found = jaccard.incidence(docs).filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("doc_id").alias("weight")).withColumn("label", F.lit(1).cast("long"))
    many = {r.doc_id: r.weight - 1 + r.n_linked for r in jaccard.link_counts(docs, found, shingles=2000).join(found, "node").collect()}
    assert many == {i: links[i] for i in many} and len(many) > 50
    again = jaccard.join(frame(spark, [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (5, None)])).collect()
    assert sorted((r.n_shingles, r.doc_id is None, r.n_links) for r in again) == [(0, False, 0), (3, False, 1), (3, False, 1), (3, True, 2)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (200, 200)]
    got = {r.node: r.label for r in jaccard.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_sketch_bound_never_loses_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 200, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.concatenate((base[: max(1, int(n * 0.93))], rng.integers(0, 1 << 63, max(0, n // 20), dtype=np.uint64))))
        x, y = jaccard.sketch(base), jaccard.sketch(other)
        for gap in (jaccard.differing(x, y), jaccard.differing(jaccard.folded(x), jaccard.folded(y))):
            assert len(np.intersect1d(base, other)) <= (len(base) + len(other) - gap) / 2


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 30, 30, 15, 15])] + [(50, None), (51, ""), (8, "w1 w2 w1"), (60, "W1-w2, w3! W4")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    docs += [(100 + k, f"x {t} y {t}") for k, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, LONG + " " + items[6][1] + " " + LONG), (203, "?!")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = brute.windows(items)
    for r in decontam.match(frame(spark, docs), benchmark).collect():
        want = brute.leaks(dict(docs)[r.doc_id], windows)
        assert (r.n_words, r.n_hit, list(r["items"])) == want, r.doc_id
        assert sum(s.end - s.begin for s in r.spans) == r.n_hit
    one, many = (decontam.match(frame(spark, [*docs, docs[70]]), benchmark, block_words=n).collect() for n in (10**6, 12))
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert decontam.match(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0
    assert decontam.match(frame(spark, []), benchmark).count() == 0


def test_packed_automaton_is_small():
    """Ten blocks of a benchmark: each one takes little once packed, and what is broadcast is one block."""
    rng = random.Random(3)
    items = [(str(i), [f"w{rng.randrange(5000)}".encode() for _ in range(100)]) for i in range(200)]
    for k in range(0, 200, 20):
        some = items[k : k + 20]
        assert len(pickle.dumps(decontam.Automaton(some))) < 100 * sum(len(w) for _, w in some)


def test_decontamination_blocks_agree(spark):
    items = [(str(i), f"a{i} b{i % 3} c{i % 2} d e f g h i j k".encode().split()) for i in range(9)]
    whole = decontam.Automaton(items)
    parts = [decontam.Automaton(items[i : i + 2]) for i in range(0, 9, 2)]
    text = b"x a3 b0 c1 d e f g h i j k y b1 c0 d e f g h i j z".split()
    assert decontam.check_words(text, [whole]) == decontam.check_words(text, parts)


def test_decontaminate_decides_by_all_blocks(spark):
    rng = random.Random(3)
    word = lambda k: f"{'abcdefgh'[k]}{rng.randint(0, 40)}"
    items = [(i, " ".join(word(i % 8) for _ in range(rng.choice([4, 12, 30])))) for i in range(12)] + [(None, "left out"), (90, None), (91, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda n: " ".join(f"z{rng.randint(0, 999)}" for _ in range(n))
    docs = [(i, " ".join([filler(rng.randint(0, 30)), *[x for k in rng.sample(range(12), rng.randint(0, 4)) for x in (items[k][1], filler(rng.randint(0, 20)))]]), "x") for i in range(80)]
    # 30 of one item and 30 of another, of 100 words; a cut that joins two halves of an item; rows without text; repeated rows.
    first, second = (next(t for _, t in items[k:] if t and len(t.split()) == 30) for k in (0, 6))
    halves = items[1][1].split()
    docs += [(100, f"{filler(20)} {first} {filler(20)} {second}", "x"), (101, f"y y {' '.join(halves[:2])} {second} {' '.join(halves[2:])}", "x"), (102, None, "x"), (103, "", "x"), (None, first, "x"), (100, f"{filler(3)} {first}", "x"), (7, docs[7][1], "x")]
    rows = frame(spark, docs, "doc_id long, text string, __words2 string")
    for limits in ({"max_share": 0.5}, {"max_share": 0.5, "max_words": 1000}, {"max_words": 12}, {"max_share": 0.0}):
        whole, many = (sorted(map(repr, map(tuple, decontam.decontaminate(rows, benchmark, block_words=n, **limits).collect()))) for n in (10**6, 20))
        assert whole == many
    assert repr((100, docs[80][1], "x")) not in whole
    whole, many = (sorted(map(repr, decontam.match(rows, benchmark, block_words=n).collect())) for n in (10**6, 20))
    assert whole == many and len(whole) == len(docs)


def test_decontaminate_cuts_until_clean(spark):
    item = " ".join(f"q{i}" for i in range(20))
    ws = item.split()
    docs = [(1, "keep this"), (2, f"before {item}, after"), (3, " ".join(ws[:6] + ws[:12] + ws[6:12]) + " tail"), (4, item), (5, None), (6, "")]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    source = frame(spark, [(i, t, "s", 1) for i, t in docs], "doc_id long, text string, source string, spans int")
    got = {r.doc_id: r.text for r in decontam.decontaminate(source, benchmark).collect()}
    assert got[1] == "keep this" and got[2].split() == ["before", ",", "after"] and got[5] is None and got[6] == ""
    windows = brute.windows([(1, item)])
    assert all(brute.leaks(t, windows)[1] == 0 for t in got.values())
    two = spark.createDataFrame([(1, item), (2, "keep")], "item_id long, text string")
    assert {r.doc_id: r.text.split() if r.text else r.text for r in decontam.decontaminate(source, two, block_words=1).collect()} == {i: t and [w for w in t.split() if w != "keep"] for i, t in got.items()} | {6: ""}
    strict = {r.doc_id for r in decontam.decontaminate(source, benchmark, max_share=0.0).collect()}
    assert strict == {1, 5, 6}


def test_shards_are_whole_near_equal_and_gapless(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300) + str(i)) for i in range(3000)] + [(10_000 + i, "copy " * 20) for i in range(1500)] + [(20_000, None), (20_001, ""), (20_002, None), (20_002, None), (None, "no id")]
    docs = frame(spark, [(i, t, "e") for i, t in rows], "doc_id long, text string, Shard string")
    got = shards.shard(docs, 8, cell_rows=100).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t in rows)
    size, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == 8 + len((r.text or "").encode()) and r.text_crc32 == zlib.crc32((r.text or "").encode())
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text].add(r.shard)
    assert sorted(size) == list(range(8))
    mean = sum(size.values()) / 8
    assert all(abs(v - mean) < 0.05 * mean for v in size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(len(v) > 1 for v in where.values()) <= 1  # only the text that fills several shards is split


def test_shards_keep_texts_whole_where_they_fit(spark):
    rng = random.Random(8)
    rows = [(i, f"own {i} " + "x" * rng.randint(0, 80)) for i in range(4000)]
    rows += [(10_000 + 1000 * g + i, f"group {g} " * 6) for g in range(12) for i in range(rng.randint(60, 330))]  # up to about half a shard
    rows += [(90_000 + i, "larger than a shard " * 9) for i in range(900)]
    rows += [(77, "one row, very often " * 3)] * 700  # equal ids and texts
    got = shards.shard(frame(spark, rows).withColumn("__own", F.lit(1)).drop("__own"), 12, cell_rows=50).collect()
    size, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text].add(r.shard)
    mean = sum(size.values()) / 12
    assert len(got) == len(rows) and sorted(size) == list(range(12)) and all(abs(v - mean) < 0.05 * mean for v in size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {t[:10] for t, s in where.items() if len(s) > 1} <= {"larger tha", "one row, v"}


def test_shards_of_little(spark):
    assert shards.shard(frame(spark, []), 4).count() == 0
    one = shards.shard(frame(spark, [(1, "a")]), 4).collect()
    assert len(one) == 1 and one[0].slot == 0
    same = shards.shard(frame(spark, [(7, "a")] * 50), 4).collect()
    assert len(same) == 50 and len({(r.shard, r.slot) for r in same}) == 50


LANGS = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["straße", "über", "schön", "weiß"], "cc": ["perché", "città", "gnocchi", "più"]}


def test_language_id(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(LANGS[k]) for _ in range(rng.randint(3, 30))), k) for i, k in enumerate(list(LANGS) * 60)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", None), (1003, "LOREM IPSUM", None), (1004, "日本語", None), (1005, "lorem " * 200_000, None), (1006, "straße", None)]
    docs = frame(spark, rows + odd, "doc_id long, text string, lang string")
    filters = langid.fit(docs, ~langid.held_out(), min_count=1)
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("score", F.lit("clash")), filters).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1005, 1006)] == ["und", "und", "und", "aa", "aa", "bb"]
    assert got[1004].lang_pred in LANGS and all(0 <= r.score <= 1 for r in got.values())
    thin = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, filters).collect()}
    assert thin == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_language_id_equals_plain_sets(spark):
    """The same n-grams in plain sets, without hashing: same languages, and scores as near as false positives allow; ties and repeated rows too."""
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(LANGS[k]) for _ in range(rng.randint(1, 12))), k) for i, k in enumerate(list(LANGS) * 40)]
    ask = [*rows, *rows[:9], (900, "lorem straße città", None), (901, "lorem lorem straße straße", None), (902, "zq", None), (903, "Ipsum, DOLOR. más", None)]

    def plain(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        return [f" {w} "[i : i + n] for n in langid.ORDERS for w in words for i in range(len(w) + 3 - n)]

    counts = {k: defaultdict(int) for k in LANGS}
    for _, t, k in rows:
        for g in plain(t):
            counts[k][g] += 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    top = {g: max(c.get(g, 0) / total[k] for k, c in counts.items()) for c in counts.values() for g in c}
    member = {k: {g for g, n in c.items() if n >= langid.MIN_COUNT and n / total[k] >= langid.MIN_SHARE * top[g]} for k, c in counts.items()}
    filters = langid.fit(frame(spark, rows, "doc_id long, text string, lang string"), F.lit(True))
    for r in langid.identify(frame(spark, ask, "doc_id long, text string, lang string"), filters).collect():
        found = plain(r.text)
        share = {k: sum(g in member[k] for g in found) / len(found) for k in LANGS}
        assert abs(r.score - max(share.values())) < 0.02 and share[r.lang_pred] > max(share.values()) - 0.02, r
    unknown = langid.identify(frame(spark, [(1, " ".join("qzxkwv"[i % 5 :] + "yj" * (i % 3) for i in range(60)), None)], "doc_id long, text string, lang string"), filters).first()
    assert not unknown.lang_known


def test_language_id_learns_from_its_rows_only(spark):
    rows = [(i, "lorem ipsum dolor" if i % 2 else "straße über schön", "aa" if i % 2 else "bb") for i in range(200)]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows]
    filters = langid.fit(frame(spark, wrong, "doc_id long, text string, lang string"), ~langid.held_out(), min_count=1)
    assert filters.languages == ["aa", "bb"]
    none = langid.fit(frame(spark, [], "doc_id long, text string, lang string"), ~langid.held_out())
    assert langid.predict(frame(spark, [(1, "abc")]), none).first().lang_pred == "und"


def test_many_languages_share_one_filter(spark):
    rows = [(i * 10 + j, " ".join(f"{chr(97 + i)}{c}{chr(97 + i)}{c}" for c in "mnopqr"), f"l{i:02}") for i in range(11) for j in range(5)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    filters = langid.fit(docs, F.lit(True), min_count=1)
    assert filters.masks.shape[0] == 2
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, filters).collect())


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(7)
    pieces = ["a@b.c", "a@b.c_x@d.e", "x.y+z@mail.example.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0255.1.1.001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "+1 2 3 4 5 6 7 8 9 0 1",
              "1.1.1.1@x.y", "é", "𝒳", "@", ".", "12345678901234567890123", "GB82 WEST 1234 5698 7654 32", "078-05-1120", " ", "-", "x@y", "٣"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "7" * 30_000), (1003, "a" * 30_000 + "@b.c"), (1004, "a@b" + ".c" * 20_000), (1005, "1." * 20_000), (1006, "1 " * 20_000)]
    got = pii.find(frame(spark, rows).withColumn("spans", F.lit(3))).collect()
    base = {k.name for k in pii.KINDS if k.base}
    for r in got:
        assert [f"{s.kind}:{s.begin}:{s.end}" for s in r.spans if s.kind in base] == brute.pii(dict(rows)[r.doc_id]), r.doc_id
    assert pii.find(frame(spark, [])).count() == 0


def test_personal_data_validators_and_context(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 here"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "her ssn is 078-05-1120"), (4, "part 078-05-1120 of it"), (5, "card 4111111111111111"), (6, "number 4111111111111111")]
    got = {r.doc_id: r for r in pii.redact(frame(spark, rows)).collect()}
    assert got[1].text == "IBAN [IBAN] here" and got[2].text == rows[1][1] and got[3].text == "her ssn is [SSN]" and got[4].text == rows[3][1]
    assert got[5].spans[0].score > got[6].spans[0].score


def test_secrets_need_variety_and_context(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'token = "{key}"'), (2, f"see commit {key} of it"), (3, f"plain {key} text"), (4, "password: aaaaaaaaaaaaaaaaaaaaaaaaa1"), (5, f"API_KEY={key}=="), (6, "secret abcdefghijklmnopqrstuvwxyz"), (7, f"TOKEN '{key.upper()}'"), (8, f"the key of commit {key}"),
            (9, "part GB82 WEST 1234 5698 7654 32 in stock"), (10, "GB82WEST12345698765432"), (11, None)] * 2
    got = pii.find(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: [(s.kind, s.end - s.begin) for s in r.spans] for r in got if r.spans} == {1: [("secret", 40)], 5: [("secret", 42)], 7: [("secret", 40)], 10: [("iban", 22)]}
    assert all(0 <= s.score <= 1 and s.score >= pii.MIN_SCORE for r in got for s in r.spans)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(8)
    pieces = ["under the MIT License", "under\nthe-mit license", "apache license, version 2.0", "Apache License Version 2", "CC BY-NC", "cc.by.nc", "ccc by nc", "under the mit licensé", "word", "é", "12", "cc by", "nc", "_", "under the mit"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 20)))) for i in range(150)] + [(900, None), (901, ""), (902, LONG + " cc by nc " + LONG)]
    for r in licenses.scan(frame(spark, rows).withColumn("spans", F.lit(1))).collect():
        assert (r.n_words, sorted((b.word, b.label) for b in r.base)) == brute.phrases(dict(rows)[r.doc_id])
    assert licenses.scan(frame(spark, [])).count() == 0


def test_notices_are_found_with_errors_and_not_beyond():
    scanner = licenses.Scanner()
    for label, text, errors in licenses.NOTICES:
        rng = random.Random(len(text))
        for n in range(errors + 1):
            changed = list(text)
            for at in sorted(rng.sample(range(len(text)), n), reverse=True):
                changed[at : at + 1] = rng.choice([[], ["#"], [changed[at], "#"]])
            found = scanner.spans("xx yy " + "".join(changed) + " zz")
            assert label in {f[2] for f in found}, (text, "".join(changed))
    assert scanner.spans("all of these words are reserved for others, and permission was granted") == []


def test_adjacent_notices_are_all_found():
    scanner = licenses.Scanner()
    assert [(a, b) for a, b, _, _ in scanner.spans("all rights resrved. all rights reserved. all rights reservd")] == [(0, 18), (20, 39), (41, 59)]
    rng = random.Random(12)
    for label, text, errors in licenses.NOTICES:
        for _ in range(20):
            low, want = "", []
            for _ in range(rng.randint(2, 6)):
                changed = list(text)
                for at in sorted(rng.sample(range(6, len(text) - 6), rng.randint(0, min(errors, 2))), reverse=True):
                    changed[at : at + 1] = rng.choice([["#"], [changed[at], "#"]])
                low += " " + "\n" * rng.randint(0, 3)
                want.append((len(low), len(low) + len(changed)))
                low += "".join(changed)
            assert [(a, b) for a, b, found, _ in scanner.spans(low) if found == label] == want, low


def edits(notice, low):
    """Fewest edits between notice and a stretch of low that ends at each place."""
    row = [0] * (len(low) + 1)
    for i, x in enumerate(notice, 1):
        new = [i]
        for j, y in enumerate(low, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row


def test_notices_equal_edit_distances(spark):
    """A notice is reported exactly where the edit distance allows one: in texts with edited, cut, neighbouring and repeated notices."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        low = ""
        for _ in range(rng.randint(0, 4)):
            _, text, errors = rng.choice(licenses.NOTICES)
            changed = list(text)
            for _ in range(rng.choice([0, 1, errors, errors + 1, errors + 3])):
                at = rng.randrange(len(changed))
                changed[at : at + 1] = rng.choice([[], ["#"], [changed[at], "q"]])
            low += rng.choice(["", " ", "\n\n", " word "]) + "".join(changed)
        texts.append(low)
    rows = [(i, t.upper() if i % 2 else t) for i, t in enumerate(texts)] * 2
    for r in licenses.scan(frame(spark, rows)).collect():
        low = texts[r.doc_id]
        for label in {n[0] for n in licenses.NOTICES}:
            own = [(edits(text, low), errors) for name, text, errors in licenses.NOTICES if name == label]
            ends = {j for row, errors in own for j, d in enumerate(row) if d <= errors}
            spans = [(x.begin, x.end) for x in r.spans if x.label == label]
            assert bool(spans) == bool(ends) and all(b in ends for _, b in spans), (label, low)
            slack = 2 * max(e for _, e in own)
            assert all(any(a - slack <= j <= b + slack for a, b in spans) for j in ends), (label, low)


def test_urls(spark):
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    bad = [(i, f"http://shop.com/pills/{i}", True) for i in range(60)]
    good = [(100 + i, f"http://shop.com/news/{i}.html", False) for i in range(60)]
    more = [(300, "http://Shop.COM/pills/999?x=1", None), (301, "http://shop.com/news/abc", None), (302, None, None), (303, "no scheme", None), (304, "https://a.example.net/en/1", None), (305, "https://a.example.net/EN/1", None),
            (306, "http://x.net", None), (307, "http://notexample.com/de/", None), (308, "http://m.example.com/de/9#f", None), (309, "://h/p?q", None), (310, "http://x.org/fr/" + "d/" * 40, None)]
    pages = frame(spark, bad + good + more, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in urltree.judge(pages, rules).collect()}
    assert len(got) == 131 and got[300].verdict == "block" and got[300].host == "shop.com" and got[301].verdict == "allow"
    assert all(got[i].verdict == "block" for i in range(60)) and all(got[100 + i].verdict == "allow" for i in range(60))
    assert got[0].template == got[300].template and got[0].template != got[100].template
    assert [(got[i].host, got[i].path, got[i].rule) for i in (302, 303, 304, 305, 306, 307, 308, 309)] == [
        ("", "", None), ("", "", None), ("a.example.net", "/en/1", "example.net/en/"), ("a.example.net", "/EN/1", "net/"), ("x.net", "", None), ("notexample.com", "/de/", None), ("m.example.com", "/de/9", "example.com/de/"), ("h", "/p", None)]
    assert got[310].rule == "org/fr/" and got[310].template == "/{word}" * 41  # fr and 40 more
    assert urltree.judge(frame(spark, [], "page_id long, url string, bad boolean"), rules).count() == 0


def test_url_sections_of_a_large_host(spark):
    """A section of far less than the fair share, all bad, among good ones; the same section on a small host."""
    name = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:03}")
    rows = [(1000 * k + i, f"http://large.com/{name(k)}/{i}", k == 7) for k in range(120) for i in range(30)]
    rows += [(900_000 + 1000 * k + i, f"http://small.com/{name(k)}/{i}", k == 7) for k in range(7, 10) for i in range(30)]
    got = {r.page_id: r for r in urltree.judge(frame(spark, rows, "page_id long, url string, bad boolean"), ()).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if r.verdict == "block"} == {i for i, _, bad in rows if bad}
    assert got[7000].template.startswith(f"/{name(7)}/") and got[8000].template == got[9000].template


def plain_templates(rows, min_urls=urltree.MIN_URLS, min_share=urltree.MIN_SHARE, similar=urltree.SIMILAR_Z, apart=urltree.SPLIT_Z):
    """The tree grown node by node: page -> (host, template)."""
    def shape(s):
        m = re.search(r"\.[A-Za-z0-9]{1,5}$", s)
        stem, end = (s[: m.start()], m.group()) if m else (s, "")
        kinds = ((r"[0-9]+", "{num}"), (r"[0-9A-Fa-f-]{16,}", "{hex}"), (r"[A-Za-z]+", "{word}"), (r".*[0-9].*", "{mixed}"))
        return next((k for p, k in kinds if re.fullmatch(p, stem)), "{text}") + end

    out, todo = {}, defaultdict(list)
    for i, url, bad in rows:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
        todo[m.group(1).lower() if m else "", ""].append((i, [s for s in (m.group(2) if m else "").split("/") if s], bad))
    while todo:
        (host, name), node = todo.popitem()
        deeper = []
        for i, segs, bad in node:
            if segs:
                deeper.append((i, segs, bad))
            else:
                out[i] = (host, name)
        by = defaultdict(list)
        for x in deeper:
            by[x[1][0]].append(x)
        labels = [b for _, _, b in deeper if b is not None]
        rate = sum(labels) / len(labels) if labels else 0.0
        known, fair = {}, []
        for seg, xs in by.items():
            lab = [b for _, _, b in xs if b is not None]
            p, var = (sum(lab) + rate) / (len(lab) + 1), (rate * (1 - rate) + 1e-6) / (len(lab) + 1)
            if len(xs) >= min_urls and len(xs) >= len(deeper) * min_share:
                fair.append((p, seg, var, sum(len(x[1]) for x in xs) / len(xs)))
            elif len(xs) >= min_urls and abs(p - rate) >= apart * var**0.5:
                known[seg] = seg
        groups = []
        for x in sorted(fair):
            last = groups[-1][-1] if groups else None
            if last and x[0] - last[0] <= similar * (x[2] + last[2]) ** 0.5 and abs(x[3] - last[3]) <= urltree.SIMILAR_DEPTH:
                groups[-1].append(x)
            else:
                groups.append([x])
        for g in groups:
            names = sorted(x[1] for x in g)
            known |= dict.fromkeys(names, "{" + "|".join(names) + "}" if len(names) > 1 else names[0])
        for i, segs, bad in deeper:
            todo[host, f"{name}/{known.get(segs[0]) or shape(segs[0])}"].append((i, segs[1:], bad))
    return out


def test_url_tree_equals_plain_tree(spark):
    """Merged branches, split sections, shapes, repeated rows, very long urls, columns of clashing names, no labels."""
    rng = random.Random(14)
    rows = [(i, f"http://{rng.choice(['a.com', 'A.com', 'b.org'])}/{rng.choice(['news', 'blog', 'shop', 'x1', 'pills'])}/{rng.choice(['2020', 'item', 'a-b', 'deadbeef-deadbeef'])}/{rng.randrange(50)}{rng.choice(['', '.html', '/'])}", None) for i in range(1500)]
    rows = [(i, u, None if i % 5 == 0 else rng.random() < (0.9 if "pills" in u else 0.1)) for i, u, _ in rows]
    rows += [(5000, "http://a.com/" + "d/" * 3000, None), (5001, None, True), (5002, "no scheme", False), *[(6000 + i, "http://a.com/pills/item/7", True) for i in range(3)]]
    pages = frame(spark, rows, "page_id long, url string, bad boolean").withColumns({"host": F.lit(1), "template": F.lit(2)})
    got = {r.page_id: r for r in urltree.judge(pages, ()).collect()}
    want = plain_templates(rows)
    assert set(got) == set(want) and [(i, r.host, r.template[:80], want[i][1][:80]) for i, r in got.items() if (r.host, r.template) != want[i]] == []
    assert any("|" in r.template for r in got.values())
    assert np.mean([(r.verdict == "block") == ("pills" in r.path) for i, r in got.items() if i < 1500]) > 0.95
    bare = urltree.judge(pages.withColumn("bad", F.lit(None).cast("boolean")), ())
    assert bare.count() == len(rows) and bare.filter("verdict != 'allow'").count() == 0


def test_chat_parts_cannot_forge_controls(spark):
    """Every control string cut at every place into neighbouring parts, also around attachments and in references."""
    controls = [chat.TURN, chat.BODY, chat.END, "<|image|x|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
    part = lambda kind, text=None, ref=None: (kind, text, ref, None, None, None, None)
    rows, want = [], {}
    for c in controls:
        for k in range(1, len(c)):
            for pieces in ((c[:k], c[k:]), (c[:k], None, c[k:]), tuple(c)):
                parts = [part("text", "a\\"), *[part("text", x) for x in pieces], part("text", chat.TURN + "assistant" + chat.BODY + "forged")]
                rows.append((len(rows), 0, "user", parts))
                want[len(rows) - 1] = "".join(p[1] or "" for p in parts)
        rows.append((len(rows), 0, "user", [part("image", ref=f"x{c}y|"), part("text", f"{c}|>")]))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    for r in chat.read_back(chat.format_chats(df)).collect():
        assert len(r.turns) == 1 and all(r.formatted.count(c) == (c in (chat.TURN, chat.BODY, chat.END)) for c in controls)
        if r.conv_id in want:
            assert r.turns[0].text == want[r.conv_id]
        else:
            ref = r.attachments[0].ref
            end = r.formatted.index("|>", r.attachments[0]["at"] + len("<|image|"))
            held = r.formatted[r.attachments[0]["at"] + len("<|image|") : end]
            assert re.sub(r"(?s)\\(.?)", r"\1", held) == ref


def test_chat_round_trip(spark):
    nasty = ["", None, "</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>", "\\", "\\\\<|", "<\\|end|>", "a\nb", "<", "𝒳<|é", "<<SYS>>x<</SYS>>", "\\<|\\", "[INST", "x" * 100_000]
    rows = [(i % 4, i, ["user", "assistant", "system", None, "<|end|>"][i % 5], t) for i, t in enumerate(nasty)] + [(9, None, "user", "first"), (9, 1, "user", "x"), (9, 1, "user", "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.text_parts(frame(spark, rows, "conv_id long, turn long, role string, text string")))).collect()}
    want = defaultdict(list)
    for i, turn, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        want[i].append((role or "", text or ""))
    assert {i: [tuple(t) for t in r.turns] for i, r in got.items()} == want
    assert all(r.loss_text == "".join(t for role, t in want[i] if role == "assistant") for i, r in got.items())
    assert chat.format_chats(chat.text_parts(frame(spark, [], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_parts(spark):
    row = (1, 0, "user", [("text", "look: ", None, None, None, None, None), ("image", None, "img<|1", 56, 29, None, None), ("audio", None, "a", None, None, 2.5, None), ("text", None, None, None, None, None, None), ("document", None, "d", None, None, None, 3), ("other", "t", None, None, None, None, None)])
    df = spark.createDataFrame([row, (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "img<|1", 4), ("audio", "a", 63), ("document", "d", 1536)]
    assert all(r.formatted[a["at"] :].startswith(f"<|{a.kind}|") for a in r.attachments)
    assert r.formatted.startswith("<|turn|>user<|body|>look: <|image|img<\\|\\1|>") and "t<|end|>" in r.formatted
    assert [(s.begin, s.end) for s in r.loss_spans] == [(len(r.formatted) - 7, len(r.formatted) - 7)]


def vectors(rng, n, dims=16):
    x = rng.normal(size=(n, dims)) + 2 * rng.normal(size=(7, dims))[rng.integers(0, 7, n)]
    return [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = vectors(rng, 900)
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # one vector many times
    short = [(7000 + 10 * i, [1.0 + i, 2.0, 0.5]) for i in range(5)]  # searched among themselves
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [1.0] * 15 + [None]), (5080, [float("inf")] * 16), (None, [1.0] * 16)]
    df = frame(spark, rows + odd + short, "vec_id long, vector array<float>")
    got = defaultdict(list)
    for r in ann.search(df.withColumn("list", F.lit("x")), F.col("vec_id") % 20 == 0, 20, block=16, part_blocks=2).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: [f[:2] for f in sorted(got.pop(q))] for q in (7000, 7020, 7040)} == {7000: [(1, 7040), (2, 7030), (3, 7020), (4, 7010)], 7020: [(1, 7040), (2, 7030), (3, 7010), (4, 7000)], 7040: [(1, 7030), (2, 7020), (3, 7010), (4, 7000)]}
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    recall = []
    for q, found in got.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(score[ids == i][0] - s) < 1e-9 for _, i, s in found)
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        recall.append(len({f[1] for f in found} & set(ids[best].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_by_divided_lists(spark):
    """More lists than coarse centroids: each is divided by shared residuals, and recall stays."""
    rows = vectors(np.random.default_rng(10), 1500)
    df = frame(spark, rows, "vec_id long, vector array<float>")
    index = ann.fit(df.withColumn("vector", F.col("vector").cast("array<double>")), lists=32, coarse=8)
    assert len(index.centroids) == 8 and len(index.fine) == 4 and index.lists == 32
    x = np.array([v for _, v in rows])
    found = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20, index=index, block=100).collect():
        found[r.query_id].add(r.vec_id)
    best = lambda q: {i for i in np.argsort(-(x @ x[q]), kind="stable")[:21].tolist() if i != q}
    assert np.mean([len(found[q] & best(q)) / 20 for q in range(0, 1500, 20)]) >= 0.9


def test_few_pairs_are_scored_exactly(spark):
    """Scores by table leave a small share of all pairs for exact scores, and hide none of a query's nearest."""
    x = np.random.default_rng(12).normal(size=(3000, 32)).astype(np.float32).astype(np.float64)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    index = ann.fit(df, lists=16)
    own, codes = ann.encode(index, x)
    q, near = x[::50], np.empty((60, len(x)))
    for whose in range(index.lists):
        at = np.flatnonzero(own == whose)
        near[:, at] = ann.asymmetric(index, whose, codes[at], q)
    tables = np.einsum("qmd,mcd->qmc", q.reshape(len(q), len(index.books), -1), index.books)
    assert np.allclose(near, q @ index.centre(own).T + sum(tables[:, m, codes[:, m]] for m in range(codes.shape[1])))
    score = q @ x.T
    floor = -np.sort(-score, axis=1)[:, 20]
    met = ann.promising(index, q, near, floor, 3000)
    assert met.mean() < 0.2 and met[score >= floor[:, None]].mean() > 0.99
    few = ann.promising(index, q, near, floor, 30)
    assert few.sum(axis=1).max() == 30 and not (few & ~met).any()


def test_few_neighbours(spark):
    some = ann.search(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id long, vector array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in some) == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert ann.search(frame(spark, [], "vec_id long, vector array<float>"), F.lit(True)).count() == 0
    assert ann.search(frame(spark, [(0, [1.0])], "vec_id long, vector array<float>"), F.lit(True)).count() == 0


def mixed(spark):
    rng = random.Random(11)
    good, bad = [f"fine{i}" for i in range(30)], ["awful", "nasty", "rotten"]
    rows = [(i, " ".join(rng.choice(good) for _ in range(rng.randint(5, 40))) + (" " + rng.choice(bad) if i % 4 == 0 else "")) for i in range(400)] + [(1000, None), (1001, "")]
    labels = [(i, "toxic" if i % 4 == 0 else "good") for i in range(400)] + [(5, None), (None, "good"), (9999, "good")]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string")


def test_mixing_meets_targets(spark):
    docs, labels = mixed(spark)
    rows, model = mixing.weigh(docs, labels, {"good": 1.2, "toxic": 0.8})
    got = rows.collect()
    assert model.domains == ["good", "toxic"] and len(got) == 402
    for k, factor in enumerate((1.2, 0.8)):
        now = sum(r.n_tokens * r.posterior[k] for r in got)
        assert abs(sum(r.rate * r.n_tokens * r.posterior[k] for r in got) / now - factor) < 0.01
    assert all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    assert np.mean([r.posterior[1] > 0.5 for r in got if r.doc_id < 400 and r.doc_id % 4 == 0]) > 0.95


def test_mixing_matches_a_plain_solver(spark):
    docs, labels = mixed(spark)
    rows, model = mixing.weigh(docs, labels, {"good": 0.2, "toxic": 1.0})
    got = rows.collect()
    n, p = np.array([r.n_tokens for r in got], float), np.array([r.posterior for r in got])
    goal = (n[:, None] * p).sum(axis=0) * [0.2, 1.0]
    rate = np.ones(len(n))
    scale = np.linalg.pinv((p * n[:, None]).T @ p)
    for _ in range(200):
        rate = np.maximum(rate - p @ (scale @ (p.T @ (rate * n) - goal)), 0)
    assert np.allclose(p.T @ (rate * n), p.T @ (np.array([r.rate for r in got]) * n), rtol=1e-2)


def test_mixing_copies_and_edges(spark):
    docs, labels = mixed(spark)
    wide = docs.withColumns({"posterior": F.lit("mine"), "n_tokens": F.lit(-1)})
    out = mixing.mix(wide, labels, {"good": 2.0, "toxic": 0.0})
    assert out.columns == wide.columns and out.filter("posterior != 'mine' OR n_tokens != -1").count() == 0
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert np.mean([counts.get(i, 0) for i in range(1, 400, 4)]) > 1.8 and sum(counts.get(i, 0) for i in range(0, 400, 4)) < 20
    none, model = mixing.weigh(docs, labels.limit(0), {"all": 0.5})
    assert model.domains == ["all"] and abs(none.agg(F.sum(F.col("rate") * F.col("n_tokens")) / F.sum("n_tokens")).first()[0] - 0.5) < 1e-6
    assert mixing.weigh(docs.limit(0), labels, {})[0].count() == 0


def test_mixing_long_texts_ties_and_rich_vocabularies(spark):
    """Very many different words, a very long text, rows alike, and an id labelled very often."""
    rng = random.Random(13)
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + (" vile vile" if i % 3 == 0 else " kind")) for i in range(600)] + [(5000, LONG), (5001, LONG), (7, "vile")]
    labels = [(i, "toxic" if i % 3 == 0 else "good") for i in range(600)] + [(3, "toxic")] * 500
    got, model = mixing.weigh(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string"), {"good": 1.0, "toxic": 0.5})
    got = got.collect()
    assert len(got) == 603 and {mixing.BUCKETS > b >= 0 for b in model.weights} == {True}
    assert all((r.posterior[1] > 0.5) == (r.doc_id % 3 == 0) for r in got if r.doc_id < 600 and r.n_tokens > 5)
    long = [r for r in got if r.doc_id >= 5000]
    assert long[0].posterior == long[1].posterior and long[0].rate == long[1].rate


def least_edits(initials, gone, cut):
    """Least cost and least audit by states (nothing placed, a system placed, an assistant due, a user due), every edit tried."""
    best = {}

    def go(i, state, inserted=0):
        if (i, state, inserted) not in best:
            ways = [(0, "")] if i == len(initials) and state in "SU" else []
            then = lambda cost, letter, *to: ways.append((cost + go(*to)[0], letter + go(*to)[1]))
            due, after = ("a", "U") if state == "A" else ("u", "A")
            if i < len(initials):
                then(4, "D", i + 1, state)
                if not gone[i]:
                    here = 3 if cut[i] else 0
                    then(here, "K", i + 1, after) if initials[i] == due else then(here + 3, "R", i + 1, after)
                    if state == "S" and initials[i] == "s":
                        then(here, "K", i + 1, "P")
            if inserted < 3:
                then(3, "I", i, after, inserted + 1)
            best[i, state, inserted] = min(ways) if ways else (1 << 30, "")
        return best[i, state, inserted]

    return go(0, "S")


def test_repair_finds_the_least_edits():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(0, 10)
        initials = [rng.choice(["u", "a", "s", "", "x", "u", "a"]) for _ in range(n)]
        gone = [rng.random() < 0.2 for _ in range(n)]
        cut = [not g and rng.random() < 0.3 for g in gone]
        assert repair.Alignment(initials, gone, cut, rng.choice([0, 1 << 22])).best() == least_edits(initials, gone, cut), (initials, gone, cut)
    long = ["ua"[i % 2] if rng.random() < 0.9 else rng.choice("uas") for i in range(3000)]
    none = [False] * len(long)
    assert repair.Alignment(long, none, none, 0).best() == repair.Alignment(long, none, none, 1 << 30).best()


def test_repair_of_awkward_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes"), (1, 3, "user", "Hi."), (1, None, "system", "Be kind."), (2, 5, None, None), (2, 5, "", " \t"), (None, 0, "user", "One?"), (None, 1, "assistant", "Two!"), (3, 0, "assistant", "a."), (3, 0, "user", "b.")]
    rows += [(4, i, "user" if i % 2 else "assistant", f"turn {i}.") for i in range(2000)] + [(4, 1, "user", "turn 1.")] * 2
    got = {r.conv_id: r for r in repair.repair(frame(spark, [(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, audit string, Cost string")).collect()}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].truncated, got[1].illegal, got[1].cost, got[1].audit) == (1, 0, 1, 1, 0, 7, "KKKD")
    assert [(t.role, t.text) for t in got[1].turns] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Yes")]
    assert (got[2].blank, got[2].cost, got[2].audit, got[2].turns, got[2].gaps) == (2, 8, "DD", [], 0)
    assert (got[None].cost, got[None].audit) == (0, "KK") and (got[3].audit, got[3].cost, got[3].illegal) == ("IKKI", 6, 0)
    assert (got[4].duplicate, got[4].gaps, len(got[4].turns) % 2, got[4].audit.count("D")) == (2, 0, 0, 2)
    assert repair.repair(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0
    rows = [(1, k, "assistant", "Well. Yes!") for k in range(5)] + [(1, 9, None, None)]
    hurt = repair.damage(frame(spark, rows, "conv_id long, turn long, role string, text string"), F.col("turn"), 20)
    assert sorted(map(tuple, hurt.collect())) == [(1, 1, "assistant", ""), (1, 2, "assistant", "Well Yes"), (1, 3, "assistant", "Well. Yes!"), (1, 3, "assistant", "Well. Yes!"), (1, 4, "user", "Well. Yes!"), (1, 9, " ", " ")]


def plain_secrets(text):
    """Spans of the base kinds by one plain expression each."""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"(?:{names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_spans_equal_plain_expressions(spark):
    rng = random.Random(6)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEF123456", "\n", "é𝒳", "==", "token:secret =abcdefghi", "-", "f" * 33]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, "token=" + "a1b2c3d4" * 20_000), (903, "token = a1b2c3d4e5f6g7h8; " * 8000), (903, "AKIA" * 9)]
    rows = frame(spark, [(i, t, "s", "x") for i, t in docs], "doc_id long, text string, source string, SPANS string")
    got = credentials.scan(rows, F.col("source"), F.col("doc_id"))
    assert got.columns == ["doc_id", "source", "spans", "judged"]
    base = lambda spans: tuple((s.begin, s.kind_no, s.kind, s.end) for s in spans if s.kind != "live")
    assert Counter((r.doc_id, base(r.spans)) for r in got.collect()) == Counter((i, tuple(plain_secrets(t or ""))) for i, t in docs)
    assert credentials.scan(rows.limit(0), F.col("source"), F.col("doc_id")).count() == 0


def test_secrets_by_ownership(spark):
    live, shared, forked, weak = "k3Jd93kLmQ82xTz0", "Zq82Lm3kd0TxJ93k", "M4nbV7cXz1LkJ9hG", "example0example1"
    rows = [(1, f"token={live}", "a"), (2, f"token={live} again token={live}", "a"), (3, f"password: {weak}", "b"), (4, f"Bearer key {live}{shared} here", None), (5, "commit 3f2a" + live * 2, "b")]
    rows += [(10 + i, f"secret = {shared}", f"owner{i % 40}") for i in range(400)] + [(1000 + i, f"secret = {forked}", "one") for i in range(30)] + [(2000, f"token={'Pq7' * 8}", None), (2000, f"token={'Pq7' * 8}", None)]
    docs = frame(spark, rows, "doc_id long, text string, source string", 5)
    by = {}
    for share in (credentials.HOT_SHARE, 0.4, 1.0):  # hot values apart, one only, none
        got = credentials.scan(docs, F.col("source"), F.col("doc_id"), ["doc_id"], hot_share=share).collect()
        by[share] = Counter((r.doc_id, tuple((s.kind, s.begin, s.end) for s in r.spans), tuple((j.owners, j.repositories, j.verdict) for j in r.judged)) for r in got)
    assert len(by) == 3 and len(set(map(str, map(sorted, by.values())))) == 1
    found = {k[0]: k[1:] for k in by[1.0]}
    assert found[1] == ((("assign", 0, 22), ("live", 6, 22)), ((1, 2, "live"),)) and found[3] == ((("assign", 0, 26),), ((1, 1, "weak"),))
    assert found[10] == ((("assign", 0, 25),), ((40, 400, "copied"),)) and found[1000][1] == ((1, 30, "copied"),) and len(found[2][0]) == 4
    assert found[4] == ((("live", 11, 43),), ((1, 1, "live"),)) and found[5] == ((), ()) and found[2000][1] == ((1, 1, "weak"),)


@pytest.mark.parametrize("size", [1, 300, 40_000, 1 << 40])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    for m, n, d in ((3, 7, 5), (1, 1, 1), (4, 33, 64), (2, 5, 0)):
        a, x = rng.integers(-size, size + 1, (m, d)), rng.integers(-size, size + 1, (n, d))
        want = a.astype(object) @ x.astype(object).T if d else np.zeros((m, n), object)
        got = negatives.products(a.astype(object) if size > 1 << 31 else a, x)
        assert (got == np.clip(want, -(1 << 63), (1 << 63) - 1).astype(np.int64)).all()


def plain_negatives(rows, anchors):
    rows = [(i, l, [math.floor(256 * c) if abs(c) < 1e300 else int(c) * 256 for c in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out, done = [], set()
    for a, label, v in rows:
        if not anchors(a) or (a, label, tuple(v)) in done:
            continue
        done.add((a, label, tuple(v)))
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w, strict=True)))), i, m) for i, m, w in rows if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(j, -s) for s, j, m in scored if m != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, i, k + 1, j, -p, s) for k, (j, s) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_equal_all_pairs(spark):
    rng = random.Random(8)
    vector = lambda n=6: [rng.choice([rng.uniform(-1, 1), 0.5, -0.25]) for _ in range(n)]
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), vector()) for i in range(260)] + [(300 + i, i % 3, vector(3)) for i in range(40)]
    rows += [(400, None, vector()), (401, 1, None), (402, 1, [1.0, None]), (403, 1, [float("nan")] * 6), (404, 1, [float("inf")] * 6), (None, 1, vector()), (405, 2, []), (410, 2, [])]
    rows += [(20, *rows[20][1:]), (21, *rows[21][1:]), (30, 1, vector()), (500, 7, [1e300] * 2), (510, 7, [1e300, 1.0]), (520, 8, [0.5, 0.5]), (530, 9, [0.0] * 6)]
    df = frame(spark, [(*r, "x") for r in rows], "vec_id long, label int, vector array<double>, rank string")
    for block, chunk in ((7, 200), (4096, 1 << 25)):
        got = negatives.mine(df, F.col("vec_id") % 10 == 0, block=block, chunk_bytes=chunk)
        assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_url_query_merges_and_rejects(spark, tmp_path):
    """The query of op9 over tables in which one section is bad and two are alike."""
    from trackmill.llm import queries

    pages, labels = [], []
    for k in range(1500):
        section = ("casino", "news", "blog")[k % 3]
        pages.append((k, f"https://site{k % 2}.io/{section}/item{k}/{k}"))
        labels.append((k, 0 if section == "casino" else 1, 0))
    pages += [(5000, None), (5001, "no host"), (5002, "https://site0.io"), (5003, "https://site0.io/")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.page_id: r for r in queries.op9_url_filter(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and all(got[k].verdict == ("block" if k % 3 == 0 else "allow") for k in range(1500))
    assert got[1].template == "/{blog|news}/{mixed}/{num}" and got[0].template == "/casino/{mixed}/{num}" and all(got[k].verdict == "allow" for k in range(5000, 5004))


def test_long_texts_of_notices_and_addresses(spark):
    import time

    scanner = licenses.Scanner()
    begun = time.time()
    assert len(scanner.spans("all rights resrved " * 20_000)) == 20_000 and time.time() - begun < 5
    mixed = "all rights resrved. all rights reserved. all rights reservd " * 40
    assert len(scanner.spans(mixed)) == 120
    text = "".join(f"write to person{i}@example{i}.org now é " for i in range(20_000))
    pii.find(frame(spark, [(0, "a@b.c")])).collect()
    begun = time.time()
    spans = pii.find(frame(spark, [(1, text)], parts=1)).first().spans
    assert time.time() - begun < 10 and len(spans) == 20_000 and text[spans[-1].begin : spans[-1].end] == "person19999@example19999.org"


def run_duck(name, sf_dir):
    import duckdb

    from trackmill.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def test_queries_keep_their_contracts(spark):
    """Every opN_ query on the smallest tables, against plain versions of the columns that its contract fixes."""
    from trackmill.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    texts = {r.doc_id: r.text for r in read("documents")}
    run = {name: [r.asDict() for r in f(spark, sf_dir).collect()] for name, f in queries.queries().items() if name.startswith("op")}
    for name in queries.oracle_sql():
        fixed = run_duck(name, sf_dir)
        key = lambda r: str(sorted(r.items()))
        assert sorted([{c: r[c] for c in fixed[0]} for r in run[name]], key=key) == sorted(fixed, key=key), name
    for r in run["op1_language_id"]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
    assert len(run["op1_language_id"]) == len(texts)
    by = defaultdict(list)
    for r in run["op2_sharding"]:
        assert (r["law"], r["grown_shard"], r["text_crc32"], r["size"]) == ("bytes", None, brute.crc(texts[r["doc_id"]]), 8 + len((texts[r["doc_id"]] or "").encode()))
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == len(texts)
    for r in run["op3_mixing"]:
        assert r["rate"] >= 0 and abs(sum(v for k, v in r.items() if k.startswith("p_")) - 1) < 1e-9
    vectors = {r.vec_id: np.array(r.embedding, float) for r in read("embeddings") if r.embedding is not None}
    hits = []
    for q in {r["query_id"] for r in run["op5_nearest_neighbours"]}:
        found = sorted((r["rank"], r["vec_id"], r["score"]) for r in run["op5_nearest_neighbours"] if r["query_id"] == q)
        score = {i: float(v @ vectors[q]) for i, v in vectors.items() if i != q and np.isfinite(v).all() and v.any()}
        assert q % 20 == 0 and [f[0] for f in found] == list(range(1, min(20, len(score)) + 1)) and all(abs(score[i] - s) < 1e-9 for _, i, s in found)
        hits.append(len({f[1] for f in found} & set(sorted(score, key=lambda i: (-score[i], i))[:20])) / len(found))
    assert np.mean(hits) >= 0.9
    for r in run["op8_license_scan"]:
        n, base = brute.phrases(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    urls = {r.page_id: r.url for r in read("pages")}
    for r in run["op9_url_filter"]:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "", re.S)
        host, path = (brute.low(m.group(1)), m.group(2)) if m else ("", "")
        fits = [(len(rule), rule, verdict) for verdict, rule in queries.RULES for h, p in [rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None) and (not fits or r["verdict"] == max(fits)[2])
    for r in run["op10_personal_data"]:
        base = brute.pii(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(",".join(base)) and [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b.startswith(k + ":") for b in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(r["spans"].split(","))


def stage_input(spark, rows):
    return frame(spark, [(i, t, "en", "web", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __Row string")


def test_pipeline_near_duplicates_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:59], "z"]), " ".join(f"o{i}" for i in range(20))
    rows = [(1, text), (1, text), (2, text), (2, other), (3, near), (None, text), (None, other + " more"), (None, None), (5, None), (5, None), (6, ""), (7, "  "), (None, "alone but short"), (8, "alone but short"), (8, "alone but short")]
    got = sorted(((r.doc_id is None, r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, stage_input(spark, rows), "").collect()), key=str)
    want = sorted([(False, 1, text), (False, 2, other), (True, None, None), (False, 5, None), (False, 5, None), (False, 6, ""), (False, 7, "  "), (False, 8, "alone but short")], key=str)
    assert got == want
    empty = corpus_pipeline.near_duplicates(spark, stage_input(spark, rows[:0]), "")
    assert empty.count() == 0 and empty.columns == stage_input(spark, []).columns


def test_pipeline_stages_on_awkward_rows(spark):
    """Nulls, empty texts, repeated and null ids, extra columns of clashing names and empty tables go through each stage."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    rows = [*awkward(), (None, None), (None, "no id here at all"), (20, "same id, other words"), (3, "one two")]
    docs = stage_input(spark, rows)
    count = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.select("doc_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, sf_dir), stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0, name
        kept = count(out)
        if name == "shard":
            assert kept == count(docs) and set(docs.columns) <= set(out.columns)
        else:
            assert out.columns == docs.columns and set(kept) <= set(count(docs)), name


@pytest.mark.parametrize("name", ["pipeline"])
def test_pipeline(spark, name):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    groups, windows = brute.jaccard(list(texts.items())), brute.windows(items)
    kept = docs
    for stage, f in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(f(spark, kept, sf_dir).collect(), docs.schema)
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        gone = {
            "language": {i for i in before if not any(c.isalpha() for c in texts[i] or "")},
            "near_duplicates": {i for i in before if groups[i][1] != i},
            "decontaminate": {i for i in before if brute.leaks(texts[i], windows)[1]},
        }[stage]
        assert before - after == gone, stage
    # What the rates give, by the operator's own posteriors and a plain solver: a document's copies follow from its rate.
    labels = {r.doc_id: "toxic" if r.toxic == 1 else {1: "good", 0: "poor"}.get(r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    named = spark.createDataFrame([(i, d) for i, d in labels.items()], "doc_id long, domain string")
    from trackmill.llm.queries import TARGETS

    weighed, model = mixing.weigh(kept, named, TARGETS)
    weighed = weighed.collect()
    n, p = np.array([r.n_tokens for r in weighed], float), np.array([r.posterior for r in weighed])
    goal = (n[:, None] * p).sum(axis=0) * [TARGETS[d] for d in model.domains]
    rate, scale = np.ones(len(n)), np.linalg.pinv((p * n[:, None]).T @ p)
    for _ in range(500):
        rate = np.maximum(rate - p @ (scale @ (p.T @ (rate * n) - goal)), 0)
    assert np.allclose(p.T @ (rate * n), p.T @ (np.array([r.rate for r in weighed]) * n), rtol=2e-2, atol=1e-3 * goal.sum())
    copies = {r.doc_id: r.copies for r in weighed}
    assert all(math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1 for r in weighed)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == Counter({i: c for i, c in copies.items() if c})
    bytes_of = Counter()
    for r in out:
        bytes_of[r.shard] += 8 + len(r.text.encode())
    assert max(bytes_of.values()) <= sum(bytes_of.values()) / 24 + max(8 + len(r.text.encode()) for r in out)
    assert {r.doc_id for r in out} <= {r.doc_id for r in kept.collect()} and len({(r.shard, r.slot) for r in out}) == len(out)
    assert set(docs.columns) <= set(out[0].asDict())
