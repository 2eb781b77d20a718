"""A corpus pipeline: each stage reads what the one before kept, and all but the last return the columns of documents.

Language ID drops documents without a language and ambiguous ones and sets ``lang``; the n-gram join leaves the first
row of each group, also among rows without a doc_id or with a repeated one; substring dedup cuts repeated passages out of the texts and drops what is then empty; mixing
draws documents by raked weights, ``SHARE`` of the tokens; packing places the tokens of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm.common import cut, spread_rank
from codexloom.llm.language_id import UNKNOWN, fit, predict
from codexloom.llm.mixing import SHARE, mix
from codexloom.llm.ngram_join import similarity_classes
from codexloom.llm.packing import pack
from codexloom.llm.queries import word_tokenizer
from codexloom.llm.substring_dedup import remove_repeats
from codexloom.llm.training_order import shared_table

#: Repeated doc_ids up to which they are broadcast.
MOST_REPEATED = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = predict(docs.select(*COLUMNS), fit(docs))
    return rows.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each repeated doc_id and equal text, with ``_key``, which no two share.

    The key is the doc_id; further texts of a repeated doc_id, and rows without one, get keys above all doc_ids.
    """
    docs = docs.select(*COLUMNS).withColumn("_key", F.col("doc_id").cast("long"))
    known = docs.filter("_key is not null")
    repeated = cut(known.groupBy("_key").count().filter("count > 1").select("_key"))
    n, top = repeated.count(), docs.agg(F.max("_key")).first()[0] or 0
    few = F.broadcast(repeated) if n <= MOST_REPEATED else repeated
    odd = docs.filter("_key is null").unionByName(known.join(few, "_key", "left_semi") if n else known.limit(0))
    odd = cut(odd.groupBy("_key", "doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("_r")).select("_key", "doc_id", "text", "_r.*"))
    leads = odd.filter("_key is not null").groupBy("_key").agg(F.min(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("_r")).select("_key", "_r.*")
    held = leads.select(F.col("_key").alias("_k"), F.col("text").alias("_t"))
    further = odd.join(held, (F.col("_key") == F.col("_k")) & F.col("text").eqNullSafe(F.col("_t")), "left_anti")
    further = spread_rank(cut(further.drop("_key")), [], ["doc_id", "text"], "_key").withColumn("_key", F.col("_key") + F.lit(top + 1))
    plain = known.join(few, "_key", "left_anti") if n else known
    return plain.unionByName(cut(leads.unionByName(further)))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each similarity class by ``keyed``, so that null and repeated doc_ids are judged by their texts.

    Texts without words are alike to none, so each such row stays, once for each doc_id (null too) and text.
    """
    rows = keyed(docs)
    first = similarity_classes(rows.select(F.col("_key").alias("doc_id"), "text")).filter("doc_id = class_id").select(F.col("doc_id").alias("_key"))
    return rows.join(first, "_key", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = remove_repeats(docs.select(*COLUMNS), keep=("lang", "source", "n_chars")).filter("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    return rows.withColumn("n_chars", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, share=SHARE).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]
#: Classifiers, similarity classes and packing are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_table(docs)
    return docs
