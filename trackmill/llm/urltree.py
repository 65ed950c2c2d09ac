"""URL filter: host and path rules first, else the labelled purity of the URL's path template.

The template tree is grown level by level, for all hosts at once. At each node a path segment stays literal if it
holds a fair share of the node's URLs, or, whatever its share, if its labelled purity differs significantly from
the node's; all other segments become a wildcard of their shape ({num}, {num}.html, {word}, ..). Literal siblings of
a fair share whose labelled purity does not differ significantly, and whose subtrees are as deep, merge into one branch. A leaf is a template;
it is rejected if the share of bad URLs among its labelled ones, smoothed towards the share in all labelled ones, reaches
REJECT_PURITY, or is REJECT_LIFT times the overall share and REJECT_Z standard errors above it.

Levels are grown while some node has enough URLs to keep a literal; below that all segments are shapes, so a few very
long paths cost no levels.

Definitions at the edges: a null url, or one without `://`, has empty host and path and the empty template; without labels the method allows all; repeated
rows each count and each get their verdict; null labels count as unlabelled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment stays literal with this many URLs and this share of its node's, or this many standard errors from its node's purity.
MIN_URLS = 20
MIN_SHARE = 0.02
SPLIT_Z = 2.0
#: Siblings merge below this difference of purities in standard errors, and this difference in mean depth.
SIMILAR_Z = 1.0
SIMILAR_DEPTH = 0.5
PRIOR_WEIGHT = 10.0
REJECT_PURITY = 0.6
REJECT_LIFT = 1.5
REJECT_Z = 3.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. rules: (verdict, rule), a rule being a host and a path from its first slash on."""
    rule = verdict = F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):
        name, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """What a variable segment looks like: its digits and letters generalised, a short extension kept."""
    end = F.regexp_extract(segment, r"(\.[A-Za-z0-9]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z0-9]{1,5}$", "")
    kind = (F.when(stem.rlike(r"^[0-9]+$"), "{num}").when(stem.rlike(r"^[0-9A-Fa-f-]{16,}$"), "{hex}")
            .when(stem.rlike(r"^[A-Za-z]+$"), "{word}").when(stem.rlike(r"[0-9]"), "{mixed}").otherwise("{text}"))
    return F.concat(kind, end)


def templates(pages: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE, similar_z: float = SIMILAR_Z, split_z: float = SPLIT_Z) -> DataFrame:
    """pages (page_id, url, bad: true, false or null where unlabelled) with host, path and template."""
    seen = F.filter(F.split(F.col("path"), "/", -1), lambda s: s != "")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("boolean").alias("bad")).withColumn("__segs", seen).withColumn("template", F.lit(""))
    labelled, bad = F.count("bad"), F.count_if("bad")
    level, kept = 0, None
    ended: list[DataFrame] = []  # rows whose path has ended: they take no part in what follows, and are written once
    while True:
        at = rows.withColumn("__seg", F.try_element_at("__segs", F.lit(level + 1)))
        largest = at.filter(F.col("__seg").isNotNull()).groupBy("host", "template").count().agg(F.max("count").alias("n")).first()["n"] or 0
        if largest < min_urls:
            break
        child = at.filter(F.col("__seg").isNotNull()).groupBy("host", "template", "__seg").agg(
            F.count(F.lit(1)).alias("n"), labelled.alias("n_lab"), bad.alias("n_bad"), F.avg(F.size("__segs")).alias("deep"))
        node = child.groupBy("host", "template").agg(F.sum("n").alias("n_node"), F.sum("n_lab").alias("node_lab"), F.sum("n_bad").alias("node_bad"))
        literal = child.filter(F.col("n") >= min_urls).join(node, ["host", "template"])
        rate = F.coalesce(F.try_divide(F.col("node_bad"), F.col("node_lab")), F.lit(0.0))
        purity = (F.col("n_bad") + rate) / (F.col("n_lab") + 1)
        scored = literal.withColumns({"p": purity, "var": (rate * (1 - rate) + 1e-6) / (F.col("n_lab") + 1)})
        fair = F.col("n") >= F.col("n_node") * min_share
        apart = scored.filter(~fair & (F.abs(F.col("p") - rate) >= split_z * F.sqrt("var"))).select("host", "template", "__seg", F.col("__seg").alias("__name"))
        order = Window.partitionBy("host", "template").orderBy("p", "__seg")  # a node has 1 / min_share fair rows at most
        alike = ((F.col("p") - F.lag("p").over(order)) <= similar_z * F.sqrt(F.col("var") + F.lag("var").over(order))) & (F.abs(F.col("deep") - F.lag("deep").over(order)) <= SIMILAR_DEPTH)
        grouped = scored.filter(fair).withColumn("__new", F.when(alike, 0).otherwise(1)).withColumn("__grp", F.sum("__new").over(order))
        whole = Window.partitionBy("host", "template", "__grp")
        names = F.array_sort(F.collect_list("__seg").over(whole))
        name = F.when(F.size(names) > 1, F.concat(F.lit("{"), F.array_join(names, "|"), F.lit("}"))).otherwise(F.col("__seg"))
        known = keep(grouped.select("host", "template", "__seg", name.alias("__name")).union(apart), "branches")
        ended.append(keep(at.filter(F.col("__seg").isNull()).drop("__seg"), "ended"))
        joined = at.filter(F.col("__seg").isNotNull()).join(known, ["host", "template", "__seg"], "left")
        step = F.concat(F.lit("/"), F.coalesce("__name", _shape(F.col("__seg"))))
        rows = keep(joined.withColumn("template", F.concat("template", step)).drop("__seg", "__name"), "rows")
        forget(known, *([kept] if kept else []))
        level, kept = level + 1, rows
    rest = F.transform(F.slice("__segs", level + 1, F.greatest(F.size("__segs") - level, F.lit(0))), lambda s: F.concat(F.lit("/"), _shape(s)))
    out = rows.withColumn("template", F.concat("template", F.array_join(rest, "")))
    for part in ended:
        out = out.unionByName(part)
    return out.drop("__segs")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], prior_weight: float = PRIOR_WEIGHT, reject: float = REJECT_PURITY, lift: float = REJECT_LIFT, reject_z: float = REJECT_Z, **tree: float) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each of pages (page_id, url, bad)."""
    rows = templates(pages, **tree)
    leaves = rows.groupBy("host", "template").agg(F.count("bad").alias("n_lab"), F.count_if("bad").alias("n_bad"))
    overall = leaves.agg(F.sum("n_bad").alias("b"), F.sum("n_lab").alias("n")).first()
    prior = (overall["b"] or 0) / (overall["n"] or 1)
    leaves = leaves.withColumn("purity", (F.col("n_bad") + prior_weight * prior) / (F.col("n_lab") + prior_weight))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    error = F.sqrt(F.lit(prior * (1 - prior)) / (F.col("n_lab") + prior_weight))
    worse = (F.col("purity") >= lift * prior) & (F.col("purity") - prior >= reject_z * error)
    own = F.when(F.lit(prior > 0) & ((F.col("purity") >= reject) | worse), "block").otherwise("allow")
    return rows.join(leaves.select("host", "template", "purity", "n_lab"), ["host", "template"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
