"""Personal data: patterns propose spans, checksum validators confirm them, context words adjust the score.

DataFrame functions only. Patterns start at the first character of a run (or where the last match ended), and repeat
possessively, so a scan stays linear on long runs; their places follow from one scan (see places.py).

A kind's score is raised where context words of it stand near and lowered where words stand near that speak against
it. Base kinds (email, ip, card, phone) stay whatever their score; kinds of the method (iban, ssn, secret) need
MIN_SCORE: an account code that passes its checksum stays unless it is called something else, a nine-digit number or a
long random string counts only where it is called a taxpayer number or a key. Time for one text grows with its length.
Definitions at the edges: a null or empty text has no spans; spans of
different kinds may overlap; repeated rows are judged alike; columns called spans are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without
from .places import around, let, pieces, places

MIN_SCORE = 0.5
#: Characters on either side of a span in which context words count.
CONTEXT_CHARS = 48
CONTEXT_BONUS = 0.35
CONTEXT_MALUS = 0.35
#: A secret has this many different characters, digits and letters both.
SECRET_VARIETY = 10


@dataclass(frozen=True)
class Kind:
    """pattern: Java syntax, scanned leftmost. needs: a cheap pattern without which a text is not scanned. context, against: words that raise or lower the score."""

    name: str
    pattern: str
    needs: str
    context: str
    base: bool
    score: float
    against: str = "example|sample|dummy"


# The patterns of the base kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write to", True, 0.9),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "address|host|server|ip", True, 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9 -]{11}", "card|visa|credit|payment", True, 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|mobile|fax", True, 0.6),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", "iban|account|bank|transfer", False, 0.55, "serial|part|order|sku|model|batch"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", "ssn|social security|taxpayer", False, 0.3, "serial|part|order|sku|model|batch"),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", r"[A-Za-z0-9+/_-]{20}", "[a-z_]*(?:token|secret|key|passw(?:or)?d|pwd|credential)s?|bearer|authorization", False, 0.3, "commit|revision|sha1|sha256|md5|checksum|digest|uuid"),
)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    return F.call_function("luhn_check", number)


def mod97(code: Column) -> Column:
    """Remainder by 97 of an account code: its first four characters last, letters as 10 to 35."""
    bare = F.regexp_replace(code, r"\x20", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(F.when(c.rlike("[0-9]"), (acc * 10 + value(c)) % 97).otherwise((acc * 100 + value(c)) % 97)))


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(999)) <= 255)
    if kind == "card":
        number = digits(found)
        return F.length(number).between(14, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(found)).between(10, 15)
    if kind == "iban":
        return mod97(found) == 1
    if kind == "secret":
        kinds = F.size(F.array_distinct(F.split(found, "")))
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]") & (kinds >= SECRET_VARIETY)
    if kind == "ssn":
        return ~found.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


SPAN = "array<struct<begin:bigint,kind_no:int,kind:string,end:bigint,score:double>>"


def found(text: Column, kind: Kind, number: int) -> Column:
    """Spans of one kind in text, in order."""
    def scored(s: Column, of: Column) -> Column:
        near = F.lower(around(of, s["begin"], s["end"], CONTEXT_CHARS))
        says = lambda words: near.rlike(rf"\b(?:{words})\b")
        shift = F.when(says(kind.context), CONTEXT_BONUS).otherwise(0.0) - F.when(says(kind.against), CONTEXT_MALUS).otherwise(0.0)
        return F.struct(s["begin"].alias("begin"), F.lit(number).alias("kind_no"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.score) + shift)), 6).alias("score"))

    none = F.array().cast(SPAN)
    right = F.filter(places(text, kind.pattern), lambda s: valid(kind.name, s["h"]))
    spans = let(right, lambda x: F.when(F.size(x) > 0, let(pieces(text), lambda of: F.transform(x, lambda s: scored(s, of)))).otherwise(none))
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
    return F.when(text.rlike(kind.needs), spans).otherwise(none)


def find(docs: DataFrame, kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """docs with spans: begin, kind_no, kind, end (code points, exclusive) and score, by begin, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = without(docs, "spans")
    return docs.withColumn("spans", F.array_sort(F.concat(*[found(text, k, i) for i, k in enumerate(kinds)])))


def redact(docs: DataFrame, kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """find(), with text's spans replaced by [KIND] from the last to the first; a span that another covers in part goes with it."""
    out = find(docs, kinds)
    cut = lambda acc, s: F.when(s["end"] > acc["limit"], acc).otherwise(F.struct(
        F.concat(F.substr(acc["text"], F.lit(1), s["begin"].cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"), F.substr(acc["text"], (s["end"] + 1).cast("int"))).alias("text"), s["begin"].alias("limit")))
    return out.withColumn("text", F.aggregate(F.reverse("spans"), F.struct(F.col("text").alias("text"), F.lit((1 << 62)).cast("long").alias("limit")), cut, lambda acc: acc["text"]))
