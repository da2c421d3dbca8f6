"""A training-data pipeline in stages, each calling one operator of cohortaudit.llm.

run(spark, sf_dir) applies STAGES to the documents. Each stage is written as Parquet in
the folder that the executors share and read again as the next one's input. All but the
last keep the columns of documents, whatever further ones there are and however they are
called. A null text is an empty one; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortaudit.llm import decontaminate, langid, packing, secrets, simhash
from cohortaudit.llm.common import discard, scratch_root, small_batches, small_side, stage, temporary

#: The least share of a document's n-grams that its language must hold.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones teach; those without letters or of other text go.

    Null and empty texts go. Repeated rows stay or go together; ids don't matter and may be null.
    """
    return langid.in_language(docs, langid.train(docs), MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies, exact or near, keep the document with the smallest doc_id.

    Rows that repeat with their id and text are one document, as are all texts without
    words. Rows with the smallest id but other texts stay only if they are in its group:
    then each text once. A row without an id stays only if no copy has an id.
    """
    found, _ = stage(simhash.copies(docs).select("doc_id", "sign", "component_id"), "copies")
    ids = lambda t: docs["doc_id"].cast("long").eqNullSafe(t["doc_id"]) & (F.xxhash64(docs["text"]) == t["sign"])
    drop = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "sign").distinct()
    drop = small_side(drop, "drop")
    kept = docs.join(drop, ids(drop), "left_anti")
    again = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "sign").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "sign")
    if again.isEmpty():
        return kept
    repeated = docs.join(again, ids(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, ids(again), "left_anti").unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay. Repeated rows stay or go together; ids may be
    null. Without items all stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets and access keys in the texts; n_chars follows.

    All rows stay, repeated ones and those with null ids or texts too.
    """
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens.

    A null or empty text is its end id alone; repeated rows are packed once each; a null
    id stays null.
    """
    return packing.pack(docs)


STAGES = [("language_id", language), ("simhash_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packed)]

#: SQL can't express the fingerprints, the language filters or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; the result of the last."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        # what the stage's operators wrote goes once its result is written
        with temporary(spark), small_batches(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
