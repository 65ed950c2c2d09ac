"""A training corpus from documents in five stages; each takes what the one before kept.

1. language: documents without letters go, and those whose best score is no better than chance would give.
2. near_duplicates: of each group linked by 5-word shingles at a similarity of 0.8, the document of smallest id stays
   (null ids last; of rows with equal id and text one); texts without words are linked with nothing and stay.
3. decontaminate: a document in which a benchmark window occurs goes.
4. mix: rates from the labelled table's classifier decide how often a document stays.
5. shard: 24 shards of near-equal bytes, with a slot in each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm import decontam, jaccard, langid, mixing, shards
from trackmill.llm.common import forget, keep, shared_folder, table
from trackmill.llm.queries import TARGETS


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = langid.fit(docs.select("doc_id", "text", "lang"), ~langid.held_out())
    return langid.identify(docs, filters).filter("lang_known").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id and text together, so repeated and null ids neither lose texts nor keep copies."""
    key = F.xxhash64("doc_id", "text").alias("__key")
    rows = keep(docs.select("doc_id", key).groupBy("__key").agg(F.min("doc_id").alias("__id"), F.count(F.lit(1)).alias("__n")), "rows")
    found = jaccard.join(docs.select(key, "text").withColumnRenamed("__key", "doc_id"), count=False)
    groups = found.filter("n_shingles > 0").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group")).distinct()
    named = keep(groups.join(rows, "__key"), "named")
    best = named.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__key")).alias("b")).select("__group", F.col("b.__key").alias("__best"))
    stays = named.join(best, "__group").withColumn("__stays", F.col("__key") == F.col("__best"))
    gone = stays.filter("NOT __stays OR __n > 1").select("__key")
    repeated = keep(stays.filter("__stays AND __n > 1").select("__key"), "repeated")
    whole = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    out = whole.join(gone, "__key", "left_anti").select("__row")
    if not repeated.isEmpty():
        one = whole.join(repeated, "__key", "left_semi").groupBy("__key").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
        out = out.union(one.select("__row"))
    return out.select("__row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_share=0.0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    return mixing.mix(docs, labels, TARGETS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.shard(docs, 24)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: The first, second and fourth stage learn or follow links; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again; what a stage has read goes when it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs.kept_at = path
        if before is not None:
            forget(before)
        before = docs
    return docs
