"""Where patterns match in long texts, in DataFrame functions only and in time that grows with the text alone.

The places of a pattern's matches follow from the pieces that split() leaves between them and the matches that
regexp_extract_all() gives, both of one leftmost scan: a running sum of their lengths, first inside runs of RUN matches,
then over the runs, so that no array is copied for each match. What stands near a place is cut from PIECE characters or
two, never from the start of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 128
PIECE = 1024
PLACE = "array<struct<h:string,begin:bigint,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def places(text: Column, pattern: str) -> Column:
    """Matches of pattern (Java syntax, never empty) in text: what they match (h), begin and end (code points, exclusive), in order."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(PLACE).alias("got"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["h"])
        return F.struct(end.cast("long").alias("at"), F.concat(acc["got"], F.array(F.struct(x["h"].alias("h"), begin.cast("long").alias("begin"), end.cast("long").alias("end")))).alias("got"))

    def moved(run: Column, by: Column) -> Column:
        return F.transform(run["got"], lambda s: F.struct(s["h"].alias("h"), (s["begin"] + by).alias("begin"), (s["end"] + by).alias("end")))

    def of_hits(hits: Column) -> Column:
        sizes = F.zip_with(hits, F.slice(F.split(text, pattern, -1), 1, F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.char_length(g).cast("long").alias("gap")))
        runs = let(sizes, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(RUN)), lambda i: F.aggregate(F.slice(x, i, F.lit(RUN)), zero, step)))
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("got"))
        starts = lambda x: F.aggregate(x, none, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["got"], F.array(acc["at"])).alias("got")), lambda acc: acc["got"])
        return let(runs, lambda x: F.flatten(F.zip_with(x, starts(x), moved)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, of_hits(hits)).otherwise(F.array().cast(PLACE)))


def pieces(text: Column) -> Column:
    """text in pieces of PIECE characters."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(of: Column, begin: Column, size: Column) -> Column:
    """size (PIECE at most) characters from begin on of the text whose pieces are given."""
    k = F.floor(begin / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(of, k), F.lit("")), F.coalesce(F.get(of, k + 1), F.lit("")))
    return F.substr(both, (begin - k * PIECE + 1).cast("int"), size.cast("int"))


def around(of: Column, begin: Column, end: Column, reach: int) -> Column:
    """Up to reach characters before begin and from end on, with a space between."""
    low = F.greatest(begin - reach, F.lit(0))
    return F.concat_ws(" ", cut(of, low, begin - low), cut(of, end, F.lit(reach)))
