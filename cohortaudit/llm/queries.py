"""The registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortaudit.llm import conversations, decontaminate, langid, licenses, packing, pii, secrets, simhash, spelling, token_store, topk, toxicity, urls
from cohortaudit.llm.common import scratch_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, strong ones and linked weak ones."""
    return secrets.find_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, else the regression, on every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages"), urls.train(urls.labelled_urls(spark)))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids under a shared dictionary and read the files back."""
    folder = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_store(_table(spark, sf_dir, "documents"), folder, end_id=1)
    return token_store.digests(spark, folder)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, trained on the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and expressions in every document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every vector whose id is divisible by 50."""
    vectors = topk.quantize(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), end_id=2, length=4096)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op11_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the base kinds, and what the trees select."""
    return pii.find_private(_table(spark, sf_dir, "documents"), pii.train(pii.labelled_spans(spark))).drop("found")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, their near words, forms and roots."""
    return spelling.group_variants(spelling.count_words(_table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says, with their cheapest repair."""
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")), copies_col="copies")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_url_filter, op3_token_store, op4_decontamination, op5_toxicity, op6_simhash, op7_licenses, op8_topk, op9_packing, op10_language, op11_private, op12_spelling, op13_conversations)}
ORACLE_SQL = {"op4_decontamination": decontaminate.ORACLE, "op8_topk": topk.ORACLE}
