"""Sharding by histogram sort, law `bytes`: shards of near-equal size, rows moved once.

Rows are ordered by (hash of the text, hash of the id). The driver looks for the keys at which each shard should
end by counting exact bytes below candidate boundaries, level by level: a level splits only the cells that still
hold a wanted boundary, until some candidate is within tolerance. Each row's shard is then the number of
boundaries at or below its key, and one exchange moves the rows.

Equal texts are neighbours in that order, and a boundary goes to the nearer edge of a text that is smaller than the
tolerance. The few texts whose copies together are larger than that (SHARDS / TOLERANCE at most) are placed first, the
largest into the emptiest shard, and the rest of the order fills what room they leave; so a text stays whole wherever a
shard has room for it. Only a text too large for that is split among shards, as the law of near-equal bytes comes first.
All other steps see counts: 2 ** bits for each open cell, whatever the number of rows.

Definitions at the edges: a null text has size 8 and the checksum 0 of no bytes; null ids sort by their own hash;
repeated rows get different slots, and very many of them are told apart by a number that is written with them; an empty
table gives no rows; columns called shard, slot, size or text_crc32 are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, without

LEVEL_BITS = 12
#: A boundary may miss its place by this share of a shard.
TOLERANCE = 0.02
#: Rows that one ordered cell holds when slots are numbered; more rows make more cells.
CELL_ROWS = 1_000_000

_MIN = -(1 << 63)


def with_keys(docs: DataFrame) -> DataFrame:
    """docs plus size, text_crc32 and the sort key (__k1 of the text, __k2 of the id)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return without(docs, "size", "text_crc32", "shard", "slot").withColumns({
        "size": (F.octet_length(text) + 8).cast("long"),
        "text_crc32": F.crc32(text).cast("long"),
        "__k1": F.xxhash64(text, F.col("text").isNull()),
        "__k2": F.xxhash64(F.col("doc_id")),
    })


def _prefix(level_bits: int) -> tuple[Column, Column]:
    """The first level_bits of the 128-bit key: bits of __k1 (made unsigned), bits of __k2 beyond those."""
    k1, k2 = F.col("__k1").bitwiseXOR(F.lit(_MIN)), F.col("__k2").bitwiseXOR(F.lit(_MIN))
    a = F.shiftrightunsigned(k1, 64 - min(level_bits, 64))
    b = F.shiftrightunsigned(k2, 128 - level_bits) if level_bits > 64 else F.lit(0).cast("long")
    return a, b


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def placed_whole(texts: list[tuple[int, int]], shards: int, total: int, tolerance: float) -> tuple[dict[int, int], list[float]]:
    """The shard of each of texts (hash, bytes) that finds room whole, and the bytes that are left in each shard."""
    room, own = [total / shards] * shards, {}
    for key, size in sorted(texts, key=lambda t: (-t[1], t[0])):
        i = max(range(shards), key=room.__getitem__)
        if size <= room[i] + tolerance * total / shards:
            own[key] = i
            room[i] -= size
    return own, room


def splitters(keys: DataFrame, room: list[float], slack: float, level_bits: int = LEVEL_BITS) -> list[tuple[int, int]]:
    """Keys (k1, k2), unsigned, at which each shard but the first begins, so that each gets its room in bytes (in proportion) within slack.

    The driver holds at most one open cell for each boundary, of 2 ** level_bits counts each.
    """
    bits, end, cells = 0, 128, [(0, 0, 0)]  # cell: bytes below it, its prefix
    total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
    room = [max(x, 0.0) for x in room]
    wanted = {i: total * sum(room[:i]) / (sum(room) or 1) for i in range(1, len(room))}
    found: dict[int, tuple[int, int]] = {}
    while wanted and total:
        deeper = min(bits + level_bits, 64) if bits < 64 else min(bits + level_bits, end)
        a, b = _prefix(deeper)
        rows = keys
        if bits:
            pa, pb = _prefix(bits)
            opened = keys.sparkSession.createDataFrame([(_signed(x[1]), _signed(x[2])) for x in cells], "__a long, __b long")
            rows = keys.withColumns({"__a": pa, "__b": pb}).join(F.broadcast(opened), ["__a", "__b"], "left_semi")
        counted = rows.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("size").alias("n")).collect()
        inside: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r in counted:
            pa_, pb_ = _unsigned(r["a"]), _unsigned(r["b"])
            up = (pa_ >> (deeper - bits), 0) if deeper <= 64 else (pa_, pb_ >> (deeper - max(bits, 64)))
            inside.setdefault(up if bits else (0, 0), []).append((pa_, pb_, r["n"]))
        probes, still = [], []
        for below, pa_, pb_ in cells:
            for x, y, n in sorted(inside.get((pa_, pb_), [])):
                probes.append((below, below + n, x, y))
                below += n
        for i, want in list(wanted.items()):
            low, high, x, y = next(p for p in probes if p[1] >= want)
            key = (x << (64 - min(deeper, 64)), y << (128 - deeper) if deeper > 64 else 0)
            step = deeper if deeper <= 64 else deeper - 64
            after = (key[0] + (1 << (64 - step)), 0) if deeper <= 64 else (key[0], key[1] + (1 << (64 - step)))
            near = min((want - low, key), (high - want, after))
            if near[0] <= slack or deeper >= end:
                found[i] = near[1]
                del wanted[i]
            else:
                still.append((low, x, y))
        bits, cells = deeper, sorted(set(still))
    return [found[i] for i in sorted(found)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _at_least(k1: int, k2: int) -> Column:
    """Whether a row's key is at or beyond (k1, k2); a carry past the last key is beyond all rows."""
    if k2 >= 1 << 64:
        k1, k2 = k1 + 1, 0
    if k1 >= 1 << 64:
        return F.lit(False)
    s1, s2 = F.lit(_signed(k1 ^ (1 << 63))), F.lit(_signed(k2 ^ (1 << 63)))
    return (F.col("__k1") > s1) | ((F.col("__k1") == s1) & (F.col("__k2") >= s2))


def shard(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """docs (doc_id, text, any more columns) plus size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0)."""
    rows = with_keys(docs)
    keys = keep(rows.select("size", "__k1", "__k2"), "keys")
    whole = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    count, total = whole["n"], whole["bytes"] or 0
    # Cells of the same order, small enough to be numbered one by one: a prefix of the text's hash, and for a text
    # that alone overfills a cell also a prefix of the id's.
    bits = min(20, max(LEVEL_BITS, math.ceil(math.log2(max(1, count / cell_rows)))))
    room_rows, slack = max(64, 8 * count // (1 << bits)), tolerance * total / shards
    texts = keys.groupBy("__k1", "__k2").agg(F.count(F.lit(1)).alias("same"), F.sum("size").alias("b")).groupBy("__k1").agg(F.sum("same").alias("n"), F.sum("b").alias("b"), F.max("same").alias("same"))
    # At most count / room_rows (an eighth of the cells) and total / slack texts.
    busy = keep(texts.filter((F.col("n") > room_rows) | (F.col("b") > slack)), "busy")
    repeated = busy.filter((F.col("same") > room_rows) | (F.col("same") > 1) & (F.col("b") > total / shards)).select("__k1")
    if not repeated.isEmpty():
        apart = rows.join(F.broadcast(repeated), "__k1", "left_semi").withColumn("__k2", F.xxhash64("doc_id", F.monotonically_increasing_id()))
        rows = rows.join(F.broadcast(repeated), "__k1", "left_anti").unionByName(keep(apart, "repeated"))
        keys = keep(rows.select("size", "__k1", "__k2"), "keys")
    own, room = placed_whole([(r["__k1"], r["b"]) for r in busy.filter(F.col("b") > slack).collect()], shards, total, tolerance)
    owned = keys.sparkSession.createDataFrame([(k, i) for k, i in sorted(own.items())], "__k1 long, __own int")
    cuts = splitters(keys.join(F.broadcast(owned), "__k1", "left_anti") if own else keys, room, slack)
    number = F.lit(0)
    for cut in cuts:
        number = number + _at_least(*cut).cast("int")

    deep = F.when(F.col("n") > room_rows, F.least(F.lit(20), F.ceil(F.log2(F.col("n") / room_rows) + 3)).cast("int"))
    heavy = keep(busy.join(owned, "__k1", "left").select("__k1", deep.alias("__deep"), "__own"), "heavy")

    def celled(df: DataFrame) -> DataFrame:
        top = F.shiftrightunsigned(F.col("__k1").bitwiseXOR(F.lit(_MIN)), 64 - bits)
        part = F.when(F.col("__deep").isNull(), F.lit(0)).otherwise(F.shiftright(F.col("__k2").bitwiseXOR(F.lit(_MIN)), 40).bitwiseAND(F.lit((1 << 24) - 1)))
        fine = F.expr("CASE WHEN __deep IS NULL THEN 0L ELSE shiftrightunsigned(__part << 40, 64 - __deep) END")
        return (df.join(F.broadcast(heavy), "__k1", "left").withColumn("shard", F.coalesce("__own", number.cast("int")))
                .withColumns({"__top": top, "__part": part}).withColumn("__fine", fine)
                .withColumn("__hot", F.when(F.col("__deep").isNull(), F.lit(None).cast("long")).otherwise(F.col("__k1"))).drop("__deep", "__part", "__own"))

    cell = ["shard", "__top", "__hot", "__fine"]
    sizes = celled(keys).groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.min("__k1").alias("__first"))
    begins = F.sum("__n").over(Window.partitionBy("shard").orderBy("__first", F.col("__hot").isNotNull(), "__fine", "__top")) - F.col("__n")
    offsets = keep(sizes.withColumn("__begin", begins).select(*cell, "__begin"), "cells")  # a few times 2 ** bits rows
    ranked = celled(rows).withColumn("__hot", F.coalesce("__hot", F.lit(0).cast("long"))).withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*cell).orderBy("__k1", "__k2", "text_crc32")))
    offsets = offsets.withColumn("__hot", F.coalesce("__hot", F.lit(0).cast("long")))
    out = ranked.join(F.broadcast(offsets), cell).withColumn("slot", (F.col("__begin") + F.col("__rank") - 1).cast("long"))
    return out.drop("__k1", "__k2", "__top", "__hot", "__fine", "__begin", "__rank")
