"""Cleaning of the documents table for training, in five stages; each is written as Parquet and read by the next.

Quality rules and benchmark decontamination drop documents, line dedup drops lines, SimHash keeps the smallest id
of each group of near copies, and the last stage returns token digests of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm import bpe, decontaminate, linededup, rules, simhash
from tallyspan.llm.common import materialise, table
from tallyspan.llm.queries import RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learnt decision list keep."""
    return rules.clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 40 characters or more that 5 or more of them share; n_chars follows."""
    done = linededup.apply(docs, linededup.keep_bitmaps(docs))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, and of texts that share it the smallest hash. Rows with a null id stay."""
    same = F.xxhash64("text")
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", same.alias("hash")))
    groups = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text")).where("doc_id is not null")
    rows = groups.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id <> component_id or n > 1")
    rows = rows.select(F.col("doc_id.doc_id").alias("__other"), F.col("doc_id.hash").alias("__hash"), (F.col("doc_id") == F.col("component_id")).alias("__first"))
    gone = materialise(rows, "near-copies")
    at = lambda x: (docs["doc_id"] == x["__other"]) & (same == x["__hash"])
    left = docs.join(gone, at(gone), "left_anti")
    repeated = gone.where("__first")
    if repeated.isEmpty():
        return left
    # Rows of one id and text differ in other columns at most; the least of them stays.
    once = docs.join(repeated, at(repeated), "left_semi").groupBy("doc_id", same.alias("__hash")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return left.unionByName(once.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return bpe.encode_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Learnt rules, SimHash and BPE have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
