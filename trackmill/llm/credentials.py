"""Secret scan by ownership: a credential that many copy is an example, one that a single owner has may be live.

DataFrame functions only. Patterns propose candidates: assignments to names such as token, access keys, long hexadecimal
strings, and long mixed strings near words for credentials. Their values are hashed, and each hash is counted over the whole
corpus: in how many repositories it stands and how many owners those have. A value of more than MAX_OWNERS owners or
MAX_REPOSITORIES repositories is a widely copied example. A value of few that looks random (long enough, digits and
letters, varied, no words or patterns of placeholders) is live-looking and adds a span of kind `live` over the value;
everything else is weak. Spans of the base kinds stay whatever the verdict.

Counts are summed before each shuffle: by repository, then by owner, then by hash. Hashes that hold more than a
HOT_SHARE of all candidates, fewer than 1 / HOT_SHARE by that very condition, travel to all tasks; the others meet their
candidates by hash. Rows without candidates are not shuffled, and no text is.

Definitions at the edges: a null or empty text has no spans; a null owner or repository is one owner or repository
of its own, named null; equal repository names of two owners are two repositories; repeated rows are judged each, and
count as one repository; columns called spans or judged are replaced; an equal value proposed by several kinds at one place is judged once. Time for one text
grows with its length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .places import around, let, pieces, places

MAX_OWNERS = 2
MAX_REPOSITORIES = 20
#: A live-looking value has this many characters and different characters at least.
LIVE_CHARS, LIVE_VARIETY = 16, 8
#: Characters around a candidate without a telling form in which a word for credentials must stand.
CONTEXT_CHARS = 48
HOT_SHARE = 0.0005

# The patterns of the base kinds and what they need.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
ASSIGNED = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?(.*)$"
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
CREDENTIAL = r"\b(?:[a-z_]*(?:token|secret|key|passw(?:or)?d|pwd|credential)s?|bearer|authorization|oauth)\b"
ELSE = r"\b(?:commit|revision|sha1|sha256|md5|checksum|digest|uuid|etag)\b"
PLACEHOLDER = r"(?i)example|sample|dummy|change_?me|placeholder|your[_-]|test|x{4}|0123|1234|abcd|(.)\1{4}"


@dataclass(frozen=True)
class Kind:
    """needs: a cheap pattern without which a text is not scanned; least: characters of the value; near: whether words around must speak of credentials."""

    name: str
    pattern: str
    needs: str
    least: int
    base: bool = True
    near: bool = False


KINDS = (
    Kind("assign", ASSIGN, r"(?i)password|passwd|secret|token|api_?key", 8),
    Kind("access", ACCESS, "AKIA", 16),
    Kind("hex", HEX, r"[0-9a-f]{32}", 32),
    Kind("string", LONG, r"[A-Za-z0-9+/_-]{20}", 20, base=False, near=True),
)
LIVE = "live"
_FOUND = "array<struct<begin:bigint,kind_no:int,kind:string,end:bigint,value_begin:bigint,hash:string,random:boolean>>"


def looks_random(value: Column) -> Column:
    """Whether a value could be a real credential by its form."""
    varied = F.size(F.array_distinct(F.split(value, "")))
    return (F.char_length(value) >= LIVE_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (varied >= LIVE_VARIETY) & ~value.rlike(PLACEHOLDER)


def candidates(text: Column, kind: Kind, number: int) -> Column:
    """Candidates of one kind in text, in order, with hashes of their values."""
    none = F.array().cast(_FOUND)

    def told(s: Column) -> Column:
        value = F.regexp_extract(s["h"], ASSIGNED, 1) if kind.name == "assign" else s["h"]
        return F.struct(s["begin"].alias("begin"), s["end"].alias("end"), value.alias("value"))

    def fits(s: Column, of: Column) -> Column:
        near = F.lower(around(of, s["begin"], s["end"], CONTEXT_CHARS))
        return near.rlike(CREDENTIAL) & ~near.rlike(ELSE)

    def shown(s: Column) -> Column:
        return F.struct(s["begin"].alias("begin"), F.lit(number).alias("kind_no"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), (s["end"] - F.char_length(s["value"])).alias("value_begin"), F.sha2(s["value"].cast("binary"), 256).alias("hash"), looks_random(s["value"]).alias("random"))

    right = F.filter(F.transform(places(text, kind.pattern), told), lambda s: (F.char_length(s["value"]) >= kind.least) & (looks_random(s["value"]) if kind.near else F.lit(True)))
    if kind.near:
        right = let(right, lambda x: F.when(F.size(x) > 0, let(pieces(text), lambda of: F.filter(x, lambda s: fits(s, of)))).otherwise(x))
    return F.when(text.rlike(kind.needs), F.transform(right, shown)).otherwise(none)


def counted(rows: DataFrame) -> DataFrame:
    """hash, n (candidates), repositories and owners of each hash of rows (hash, __repository, __owner)."""
    by_repository = rows.groupBy("hash", "__owner", "__repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "__owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def scan(docs: DataFrame, owner: Column, repository: Column, carry: Sequence[str] | None = None, kinds: Sequence[Kind] = KINDS, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, hot_share: float = HOT_SHARE) -> DataFrame:
    """The columns carry of docs (all but text by default), spans and judged for each row of docs (text, ..).

    spans: begin, kind_no, kind, end (code points, exclusive) of the base kinds and of `live`, in order. judged: begin, end,
    hash, owners, repositories and verdict (live, copied or weak) of each candidate's value.
    """
    carry = [c for c in docs.columns if c.lower() not in ("text", "spans", "judged")] if carry is None else list(carry)
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in carry])
    found = docs.select(whole.alias("__carried"), owner.alias("__owner"), repository.alias("__repository"), F.concat(*[candidates(text, k, i) for i, k in enumerate(kinds)]).alias("__found"))
    # Written once, so that the numbers of rows are the same whoever reads them.
    found = keep(found.withColumn("__row", F.monotonically_increasing_id()), "candidates")
    some = found.filter(F.size("__found") > 0)
    rows = some.select("__row", "__owner", "__repository", F.explode("__found").alias("f")).select("__row", "__owner", "__repository", F.col("f.value_begin").alias("begin"), F.col("f.end").alias("end"), F.col("f.hash").alias("hash"), F.col("f.random").alias("random"))
    counts = keep(counted(rows.select("hash", "__owner", "__repository")), "ownership")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("n") > total * hot_share)
    of = rows.select("__row", "begin", "end", "hash", "random")
    known = of.join(F.broadcast(hot), "hash")  # fewer than 1 / hot_share rows
    rest = of.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(counts.filter(F.col("n") <= total * hot_share), "hash")
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    verdict = F.when(copied, "copied").when(F.col("random"), LIVE).otherwise("weak")
    both = known.unionByName(rest).withColumn("verdict", verdict)
    judged = both.groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("begin", "end", "hash", "owners", "repositories", "verdict"))).alias("judged"))
    empty = F.array().cast(judged.schema["judged"].dataType)
    out = some.join(judged, "__row").unionByName(found.filter(F.size("__found") == 0).withColumn("judged", empty))
    base = [k.name for k in kinds if k.base]
    own = F.transform(F.filter("__found", lambda s: s["kind"].isin(*base)), lambda s: F.struct(s["begin"].alias("begin"), s["kind_no"].alias("kind_no"), s["kind"].alias("kind"), s["end"].alias("end")))
    more = F.transform(F.filter("judged", lambda s: s["verdict"] == LIVE), lambda s: F.struct(s["begin"].alias("begin"), F.lit(len(kinds)).alias("kind_no"), F.lit(LIVE).alias("kind"), s["end"].alias("end")))
    return out.select("__carried.*", F.array_sort(F.concat(own, more)).alias("spans"), "judged")
