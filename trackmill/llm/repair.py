"""Structure repair of conversations: the cheapest edits that make turns alternate, by aligning them to target strings.

A conversation is well formed if the initials of its roles read (s?(ua)+)?. Its turns are aligned to each feasible
length of that alternating string by Wagner and Fischer's table, whose moves are Keep (0), Rerole to user or assistant
(3), Delete (4; the only move for a blank turn or a repeated one) and Insert of an empty turn (3); a truncated
turn that stays costs 3 more. All target lengths are ends of one string, so they share one table, over the turns that
are left and the places that are left: the row of all turns holds the cost of every length. A first, greedy repair
gives the incumbent cost; only Ukkonen's band of diagonals that can still be as cheap is filled, and what is dearer is
cut off. The audits of all cheapest lengths are traced side by side, and a length is dropped at the first letter in
which another one's is less. Rows of a large table are kept every STORED-th and filled in again while tracing.

Definitions at the edges: turns order by number (nulls first), then role, then text; the initial of a null or empty role
is that of no target; a repeated row is a duplicate; a null text is blank; conversations with a null id are one
conversation; a conversation without turns has an empty audit. Turns of one conversation are held by one task (texts,
and two bytes a turn for the table), conversations of any number by none; columns but conv_id, turn, role and text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Cells of a table up to which all rows stay in memory; beyond, one row of every STORED.
WHOLE_TABLE = 1 << 22
STORED = 256
#: Conversations that a task hands on at once.
HANDED = 512
_FAR = np.int64(1 << 40)
_BLANKS = b" \t\n\x0b\x0c\r"
_ENDS = b".!?"
#: What the initials of two turns in a row may be.
_PAIRS = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}


class Alignment:
    """Costs of making turns (initials, which must go, which are truncated) follow each target string, within a bound."""

    def __init__(self, initials: Sequence[str], gone: Sequence[bool], cut: Sequence[bool], whole: int = WHOLE_TABLE):
        self.initials, self.gone, self.cut, self.n = initials, gone, cut, len(initials)
        self.bound = self.incumbent()
        # Column k of a row stands for the diagonal on which k - low places are left more than turns.
        self.low, self.width = self.bound // DELETE, self.bound // DELETE + self.bound // INSERT + 1
        self.ramp = np.arange(self.width, dtype=np.int64) * INSERT
        self.stored = 1 if (self.n + 1) * self.width <= whole else STORED
        self.held: dict[int, np.ndarray] = {}
        self.block: tuple[int, list[np.ndarray]] = (-1, [])
        self.led: dict[int, tuple[int, int]] = {}  # places after a kept system turn: cost, and its number
        self.fill()

    def incumbent(self) -> int:
        """The cost of a greedy repair: an upper bound."""
        cost, placed, led = 0, 0, False
        for i, c in enumerate(self.initials):
            if self.gone[i]:
                cost += DELETE
                continue
            cost += TRUNCATED if self.cut[i] else 0
            if c == "s" and not placed and not led:
                led = True
                continue
            if c == "ua"[placed % 2]:
                placed += 1
            elif c in ROLES:  # the turn that is missing before it
                cost += INSERT
                placed += 2
            else:
                cost += REROLE
                placed += 1
        cost += INSERT * (placed % 2 or 2 * (led and not placed))
        return min(cost, DELETE * self.n)

    def first(self) -> np.ndarray:
        """The row of no turns left: all places that are left are inserted."""
        row = np.full(self.width, _FAR)
        row[self.low :] = np.arange(self.width - self.low) * INSERT
        return row

    def after(self, left: int, row: np.ndarray) -> np.ndarray:
        """The row of left turns from that of one less."""
        i = self.n - left
        new = np.append(row[1:], _FAR) + DELETE
        if not self.gone[i]:
            here = TRUNCATED if self.cut[i] else 0
            places = (left - self.low) & 1  # whether column 0 leaves an odd number of places, whose next is an assistant's
            fits = {"a": 1 - places, "u": places}.get(self.initials[i])
            cost = np.full(self.width, REROLE + here, dtype=np.int64)
            if fits is not None:
                cost[fits::2] = KEEP + here
            new = np.minimum(new, row + cost)
        below = self.low - left  # columns before it leave fewer than no places
        if below > 0:
            new[:below] = _FAR
        new = np.minimum.accumulate(new - self.ramp) + self.ramp
        new[new > self.bound] = _FAR
        return new

    def fill(self) -> None:
        row = self.first()
        for left in range(self.n + 1):
            if left:
                row = self.after(left, row)
            if left % self.stored == 0 or left == self.n:
                self.held[left] = row
            i = self.n - left - 1  # the turn before those left
            if i >= 0 and self.initials[i] == "s" and not self.gone[i] and DELETE * i <= self.bound:
                lead = DELETE * i + (TRUNCATED if self.cut[i] else 0)
                for k in np.flatnonzero(row + lead <= self.bound).tolist():
                    places = left - self.low + k
                    if places >= 2 and places % 2 == 0 and (places not in self.led or lead + row[k] < self.led[places][0]):
                        self.led[places] = (lead + int(row[k]), i)

    def row(self, left: int) -> np.ndarray:
        if left in self.held:
            return self.held[left]
        base = left - left % self.stored
        if self.block[0] != base:
            rows = [self.held[base]]
            for k in range(base + 1, min(base + self.stored, self.n + 1)):
                rows.append(self.after(k, rows[-1]))
            self.block = (base, rows)
        return self.block[1][left - base]

    def cost(self, left: int, places: int) -> int:
        k = places - left + self.low
        return int(self.row(left)[k]) if 0 <= k < self.width and places >= 0 else int(_FAR)

    def trace(self, left: int, places: int) -> Iterator[str]:
        """Letters of the least audit from a cell on."""
        now = self.cost(left, places)
        while left or places:
            if left and self.cost(left - 1, places) + DELETE == now:
                yield "D"
                left -= 1
            elif places and self.cost(left, places - 1) + INSERT == now:
                yield "I"
                places -= 1
            else:
                yield "K" if self.initials[self.n - left] == ("a" if places % 2 else "u") else "R"
                left, places = left - 1, places - 1
            now = self.cost(left, places)

    def led_by(self, places: int) -> Iterator[str]:
        """The same where turn number i, a system's, is kept first."""
        i = self.led[places][1]
        yield from "D" * i
        yield "K"
        yield from self.trace(self.n - i - 1, places)

    def best(self) -> tuple[int, str]:
        """The least cost over all target lengths, and the least audit of that cost."""
        plain = {p: c for k, c in enumerate(self.held[self.n].tolist()) if (p := self.n - self.low + k) >= 0 and p % 2 == 0 and c < _FAR}
        least = min([*plain.values(), *(c for c, _ in self.led.values())])
        alive = [self.trace(self.n, p) for p, c in plain.items() if c == least] + [self.led_by(p) for p, (c, _) in self.led.items() if c == least]
        out = []
        while len(alive) > 1:
            letters = [next(t, "") for t in alive]
            lowest = min(letters)
            if not lowest:
                return least, "".join(out)
            out.append(lowest)
            alive = [t for t, c in zip(alive, letters, strict=True) if c == lowest]
        return least, "".join(out) + "".join(alive[0])


def faults(turns: Sequence[tuple[str, bytes]]) -> list[str]:
    """Of each turn (role, text) its first fault: blank, duplicate, truncated or none."""
    seen: set[tuple[str, bytes]] = set()
    out = []
    for turn in turns:
        bare = turn[1].rstrip(_BLANKS)
        out.append("blank" if not bare else "duplicate" if turn in seen else "truncated" if bare[-1] not in _ENDS else "")
        seen.add(turn)
    return out


def repaired(turns: Sequence[tuple[str, bytes]], audit: str) -> list[tuple[str, bytes]]:
    """The turns that the edits of an audit leave."""
    out: list[tuple[str, bytes]] = []
    i = 0
    for edit in audit:
        want = "a" if out and out[-1][0][:1] == "u" else "u"
        if edit == "I":
            out.append((ROLES[want], b""))
            continue
        if edit != "D":
            out.append(turns[i] if edit == "K" else (ROLES[want], turns[i][1]))
        i += 1
    return out


_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role:string,text:string>>"


def judge(numbers: Sequence[int | None], turns: Sequence[tuple[str, bytes]]) -> dict:
    """What repair() says of one conversation."""
    found = faults(turns)
    initials = [role[:1] for role, _ in turns]
    known = [t for t in numbers if t is not None]
    cost, audit = Alignment(initials, [f in ("blank", "duplicate") for f in found], [f == "truncated" for f in found]).best()
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **{k: found.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in _PAIRS for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit,
        "turns": [{"role": r, "text": t.decode()} for r, t in repaired(turns, audit)]}


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, counts of faults, illegal, cost, audit and the repaired turns of each conversation of rows (conv_id, turn, role, text)."""
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [c.split(" ")[0] for c in REPAIRED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), _TURN]

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[int | None], list[tuple[str, bytes]]]]:
        whose, numbers, turns = None, [], []
        for batch in batches:
            for c, t, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist(), batch.column("role").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if turns and c != whose:
                    yield whose, numbers, turns
                    numbers, turns = [], []
                whose = c
                numbers.append(t)
                turns.append((role, text))
        if turns:
            yield whose, numbers, turns

    def packed(done: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], k) for n, k in zip(names, kinds, strict=True)], names)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        for whose, numbers, turns in conversations(batches):
            done.append({"conv_id": whose, **judge(numbers, turns)})
            if len(done) >= HANDED:
                yield packed(done)
                done = []
        yield packed(done)
        trim()

    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(judged, REPAIRED)


def damage(rows: DataFrame, lot: Column, of: int = 20) -> DataFrame:
    """rows damaged in five of `of` lots: by lot number, 0 drops a row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it a user's. Null roles and texts become one space."""
    text = F.coalesce("text", F.lit(" "))
    hurt = F.when(F.col("__lot") == 1, "").when(F.col("__lot") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("__lot") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    out = rows.withColumn("__lot", lot % of).filter("__lot != 0").select("conv_id", "turn", role.alias("role"), hurt.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("__lot") == 3, 2).otherwise(1))).alias("__copy"))
    return out.drop("__copy")
