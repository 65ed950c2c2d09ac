"""One thin query for each operator, over the whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, credentials, decontam, jaccard, langid, licenses, mixing, negatives, pii, repair, shards, urltree
from .common import table

#: Factors on each domain's expected tokens.
TARGETS = {"good": 1.1, "poor": 0.6, "toxic": 0.1}
# The URL rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = langid.fit(docs, ~langid.held_out())
    found = langid.predict(docs, filters)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    rows, model = mixing.weigh(table(spark, sf_dir, "documents"), labels, TARGETS)
    return rows.select("doc_id", "n_tokens", *[F.element_at("posterior", i + 1).alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", "copies")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.search(vectors, F.col("vec_id") % 20 == 0, 20)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    read = chat.read_back(chat.format_chats(chat.text_parts(rows.unionByName(more))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    word = F.transform("base", lambda b: b["word"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    every = F.array_sort(F.array_union(base, F.transform("spans", lambda s: s["label"])))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
                        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled if the document that its path ends in is: bad where toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("__doc", F.regexp_extract(urltree.path_of(F.col("url")), r"([0-9]{1,18})/?(?:\.html)?$", 1).try_cast("bigint"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("__doc")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    # Pages that name no document would all meet under one null key.
    named = pages.filter(F.col("__doc").isNotNull()).join(labels, "__doc", "left")
    return urltree.judge(named.unionByName(pages.filter(F.col("__doc").isNull()).withColumn("bad", F.lit(None).cast("boolean"))), RULES)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.KINDS if k.base]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    more = [k.name for k in pii.KINDS if not k.base]
    return found.select("doc_id", *[count(k) for k in base], F.sha2(written(own).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
                        *[count(k) for k in more], F.size("spans").cast("long").alias("n_found"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    lot = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary"))
    found = repair.repair(repair.damage(rows, lot))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    short = found.select("conv_id", *names, "audit", digest(written).alias("repaired_sha256"))
    out = rows.select(F.col("conv_id").alias("__id")).distinct().join(short, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("__id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", digest(F.lit(""))).alias("repaired_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository of its source, which owns it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = credentials.scan(docs, F.col("source"), F.col("doc_id"), ["doc_id"])
    base = [k.name for k in credentials.KINDS if k.base]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    judged = lambda verdict: F.size(F.filter("judged", lambda s: s["verdict"] == verdict)).cast("long").alias(f"n_{verdict}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *[judged(v) for v in (credentials.LIVE, "copied", "weak")])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_language_id, op2_sharding, op3_mixing, op4_ngram_jaccard, op5_nearest_neighbours, op6_decontamination, op7_chat_format, op8_license_scan, op9_url_filter, op10_personal_data, op11_conversation_repair, op12_secret_scan, op13_hard_negatives)
    return {f.__name__: f for f in own} | {"op4_link_counts": op4_ngram_jaccard} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
