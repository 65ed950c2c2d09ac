"""Mixing sources to target weights by soft membership, in DataFrame functions only.

1. A classifier learned from a table of labelled documents gives each document a posterior over domains: naive
   Bayes over all words, hashed into BUCKETS features whatever the vocabulary, and a few shape features (share of
   capitals, marks, repetition); features count that tell domains apart beyond chance.
2. Each document gets a nonnegative rate r (its expected number of copies). Projected-gradient least squares fits
   the rates so that the expected tokens of each domain, sum of r * tokens * posterior, match the targets. An
   iteration is one sum over all documents of as many numbers as there are domains; a document's rate follows from
   its own posterior and those sums alone, so nothing is joined and nothing but those sums reaches the driver.
3. copies = floor(r) + 1 with the chance of the fraction, drawn from a hash of the id.

The step is scaled by the domains' token moments, so a few iterations suffice unless many rates meet zero;
targets that no nonnegative rates meet are met as closely as that allows.
Definitions at the edges: a null or empty text has no tokens, so no rate counts; it gets the prior as posterior;
without any label there is one domain `all`; a document labelled twice alike counts once; repeated rows get equal rates;
null ids draw as one id.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, without

#: Bound of the labelled documents (in expectation) that the classifier is fitted on.
FIT_ROWS = 20_000
#: Features that words are hashed into; a text of 500 words meets 1.5 % of them.
BUCKETS = 1 << 15
#: A feature counts only if its log-likelihood gain over chance is at least this.
MIN_GAIN = 12.0
#: .. and if some domain has it this often more or less than all together (log ratio): common words tell little and would add up.
MIN_RATIO = 1.5
SMOOTH = 5.0
ITERATIONS = 12


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-/:-`{-\\x7f]+"), "")


def shape(text: Column, n_words: Column, n_distinct: Column) -> Column:
    """Features beside words: coarse levels of some shares."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.char_length(text), F.lit(1))
    level = lambda share, cuts: sum((F.when(share > c, 1).otherwise(0) for c in cuts), F.lit(0))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    named = {"capitals": level(share("[A-Z]"), (0.05, 0.3)), "marks": level(share("[!#$%&*@^~|<>{}\\[\\]=_]"), (0.001, 0.02)),
             "repeated": level(1 - n_distinct / F.greatest(n_words, F.lit(1)), (0.3, 0.5, 0.7, 0.85)), "words": level(n_words, (20, 100, 400))}
    return F.array(*[F.xxhash64(F.lit(f"#{name}"), value) for name, value in named.items()])


def featured(docs: DataFrame) -> DataFrame:
    """docs with n_tokens and __features: hashes of its distinct words and of its shape."""
    words = docs.withColumn("__all", tokens(F.col("text"))).withColumn("__words", F.array_distinct(F.transform("__all", lambda w: F.xxhash64(w))))
    features = F.concat("__words", shape(F.col("text"), F.size("__all"), F.size("__words")))
    return words.withColumns({"n_tokens": F.size("__all").cast("long"), "__features": features}).drop("__all", "__words")


def bucket(feature: Column) -> Column:
    return feature.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


class Classifier:
    """domains, log priors (of a document without any telling feature), and the weights of each telling bucket for each domain."""

    def __init__(self, domains: list[str], prior: list[float], weights: dict[int, list[float]]):
        self.domains, self.prior, self.weights = domains, prior, weights


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """From docs (doc_id, text) and labels (doc_id, domain); the driver gets counts of BUCKETS features at most."""
    named = labels.filter(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "domain").distinct()
    size = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size:
        return Classifier(["all"], [0.0], {})
    domains = sorted(size)
    part = F.coalesce(*[F.when(F.col("domain") == d, min(1.0, fit_rows / len(domains) / size[d])) for d in domains])
    some = named.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < part * 1_000_000)
    # One row for each id and domain, about fit_rows in all: the sample's bound is the broadcast's.
    rows = featured(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    rows = keep(rows.select("domain", F.array_distinct(F.transform("__features", bucket)).alias("features")), "labelled")
    seen = {r["domain"]: float(r["n"]) for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(seen)
    if not domains:
        forget(rows)
        return Classifier(["all"], [0.0], {})
    counts = rows.select("domain", F.explode("features").alias("f")).groupBy("f").agg(*[F.count_if(F.col("domain") == d).cast("double").alias(f"c{i}") for i, d in enumerate(domains)])
    every = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0.0))
    overall = every / sum(seen.values())
    # Shares lean on the share over all domains, as if SMOOTH more documents of each domain had it.
    share = [(F.col(f"c{i}") + SMOOTH * overall) / (seen[d] + SMOOTH) for i, d in enumerate(domains)]
    gain = sum((seen[d] * (p * F.ln(p / overall) + (1 - p) * F.ln((1 - p + 1e-9) / (1 - overall + 1e-9))) for p, d in zip(share, domains, strict=True)), F.lit(0.0))
    scored = counts.filter(every > 0).select("f", *[p.alias(f"p{i}") for i, p in enumerate(share)], overall.alias("all"), gain.alias("gain"))
    told = F.array_max(F.array(*[F.abs(F.ln(F.col(f"p{i}") / F.col("all"))) for i in range(len(domains))]))
    top = scored.filter((F.col("gain") >= MIN_GAIN) & (F.col("all") < 1) & (told >= MIN_RATIO)).orderBy("f").collect()  # BUCKETS rows at most
    forget(rows)
    total = sum(size.values())
    prior, weights = [math.log(size[d] / total) for d in domains], {}
    for r in top:
        p, every = [r[f"p{i}"] for i in range(len(domains))], r["all"]
        absent = [math.log((1 - min(x, 1 - 1e-6)) / (1 - min(every, 1 - 1e-6))) for x in p]  # what its absence says is in the prior,
        prior = [a + b for a, b in zip(prior, absent, strict=True)]
        weights[r["f"]] = [math.log(x / every) - a for x, a in zip(p, absent, strict=True)]  # and taken back by its presence
    return Classifier(domains, prior, weights)


def lookup(values: Mapping[int, str], kind: str, size: int) -> Column:
    """A constant array of size values, 0 where none is given."""
    return F.from_json(F.lit("[" + ",".join(values.get(i, "0") for i in range(size)) + "]"), f"array<{kind}>")


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with n_tokens and posterior (array, in the order of model.domains)."""
    rows = featured(without(docs, "n_tokens", "posterior"))
    k = len(model.domains)
    if not model.weights:
        top = max(model.prior)
        norm = sum(math.exp(p - top) for p in model.prior)
        return rows.withColumn("posterior", F.array(*[F.lit(math.exp(p - top) / norm) for p in model.prior])).drop("__features")
    # One bit for each bucket tells whether it has weights, so most words are done with after one look.
    bits: dict[int, int] = {}
    for b in model.weights:
        bits[b >> 5] = bits.get(b >> 5, 0) | 1 << (b & 31)
    flags = lookup({i: str(v) for i, v in bits.items()}, "bigint", BUCKETS >> 5)
    tells = lambda h: F.call_function("bit_get", F.get(flags, F.shiftright(bucket(h), 5)), bucket(h).bitwiseAND(F.lit(31))) == 1
    rows = rows.withColumn("__told", F.array_distinct(F.transform(F.filter("__features", tells), bucket)))

    def score(i: int) -> Column:
        weight = lookup({b: f"{w[i]:.9g}" for b, w in model.weights.items()}, "double", BUCKETS)
        return F.aggregate("__told", F.lit(float(model.prior[i])), lambda acc, b: acc + F.get(weight, b))

    rows = rows.withColumns({f"__s{i}": score(i) for i in range(k)})
    top = F.greatest(*[F.col(f"__s{i}") for i in range(k)]) if k > 1 else F.col("__s0")
    raised = [F.exp(F.col(f"__s{i}") - top) for i in range(k)]
    norm = sum(raised[1:], raised[0])
    return rows.withColumn("posterior", F.array(*[r / norm for r in raised])).drop("__features", "__told", *[f"__s{i}" for i in range(k)])


def rate_of(steps: list[list[float]], k: int) -> Column:
    """A document's rate after all steps: from 1, less the posterior's product with each, never below zero."""
    rate = F.lit(1.0)
    moves = [sum((F.element_at("posterior", i + 1) * float(s[i]) for i in range(k)), F.lit(0.0)) for s in steps]
    for move in moves:
        rate = F.greatest(rate - move, F.lit(0.0))
    return rate


def fit_rates(rows: DataFrame, model: Classifier, targets: Mapping[str, float], iterations: int = ITERATIONS, tolerance: float = 1e-4) -> list[list[float]]:
    """Steps of projected-gradient descent on the squared misses of the domains' expected tokens.

    rows: n_tokens, posterior. targets: a factor on each domain's tokens as they are.
    """
    k = len(model.domains)
    p = [F.element_at("posterior", i + 1) for i in range(k)]
    n = F.col("n_tokens").cast("double")
    moments = rows.agg(*[F.sum(n * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(n * p[i]).alias(f"t{i}") for i in range(k)]).first()
    now = np.array([moments[f"t{i}"] or 0.0 for i in range(k)])
    goal = now * np.array([float(targets.get(d, 1.0)) for d in model.domains])
    m = np.array([[moments[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    scale = np.linalg.pinv(m + np.eye(k) * 1e-9 * max(1.0, float(m.max())))
    steps: list[list[float]] = []
    for _ in range(iterations):
        miss = now - goal
        if np.abs(miss).max() <= tolerance * max(1.0, float(goal.sum())):
            break
        steps.append((scale @ miss).tolist())
        rate = rate_of(steps, k)
        got = rows.agg(*[F.sum(rate * n * p[i]).alias(f"t{i}") for i in range(k)]).first()
        now = np.array([got[f"t{i}"] or 0.0 for i in range(k)])
    return steps


def copies(rate: Column) -> Column:
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def weigh(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], fit_rows: int = FIT_ROWS) -> tuple[DataFrame, Classifier]:
    """doc_id, n_tokens, posterior, rate and copies of each of docs (doc_id, text), and the classifier."""
    model = fit(docs, labels, fit_rows)
    rows = keep(with_posteriors(docs.select("doc_id", "text"), model).select("doc_id", "n_tokens", "posterior"), "posteriors")
    steps = fit_rates(rows, model, targets)
    return rows.withColumn("rate", rate_of(steps, len(model.domains))).withColumn("copies", copies(F.col("rate"))), model


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """docs with all columns, each row as often as its copies say. Rows are written once with their posteriors, so features are read off each text once."""
    model = fit(docs, labels)
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = keep(with_posteriors(whole, model).select("doc_id", "__row", "n_tokens", "posterior"), "posteriors")
    steps = fit_rates(rows, model, targets)
    drawn = rows.select("__row", copies(rate_of(steps, len(model.domains))).alias("__copies"))
    return drawn.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select("__row.*")
