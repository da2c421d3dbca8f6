"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

All of it is DataFrame operations: the n-grams are cut by a regular expression, hashed
and counted by ml.feature.HashingTF, and scored by ml.classification.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortaudit.llm.common import LOWER, UPPER

#: (rule, verdict); a rule is a host, then a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
FEATURES = 1 << 16
#: (url, label, split): 90 urls that one would not crawl (1) and 90 that one would (0), written for this purpose.
TABLE = Path(__file__).with_name("labelled_urls.csv")


def labelled_urls(spark: SparkSession, split: str | None = None) -> DataFrame:
    """(url, label): the small default training table, 1 for unwanted; split: only its `train` or its `test` rows."""
    with TABLE.open(encoding="utf-8", newline="") as f:
        rows = [(r["url"], float(r["label"])) for r in csv.DictReader(f) if split in (None, r["split"])]
    return spark.createDataFrame(rows, "url string, label double")


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host, with A-Z lower-cased, and path; both empty for null and where there is no `://`."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """The longest rule that fits, as struct (rule, verdict), or null.

    Rules are a parameter of at most a few hundred; they become one expression.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ngrams(host: F.Column, path: F.Column) -> F.Column:
    """Runs of 3 and 4 characters of ^host$ and of 4 of the path, each marked by where it is from."""
    site = F.concat(F.lit("^"), host, F.lit("$"))
    cut = lambda text, n: F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.concat(cut(site, 3), cut(site, 4), F.transform(cut(path, 4), lambda g: F.concat(F.lit("/"), g)))


def _features(urls: DataFrame, url_col: str) -> DataFrame:
    host, path = split_url(F.col(url_col))
    cut = urls.withColumn("host", host).withColumn("path", path).withColumn("grams", ngrams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(cut)


def train(urls: DataFrame, url_col: str = "url", label_col: str = "label", reg: float = 0.001) -> LogisticRegressionModel:
    """Fit the regression; rows with a null url or label don't count, and there must be some of both labels."""
    rows = urls.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).where("url is not null and label is not null")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))  # both labels weigh the same together
    weighted = rows.join(F.broadcast(sizes), "label").select("url", "label", (1.0 / F.col("n")).alias("weight"))
    scaled = weighted.withColumn("weight", F.col("weight") * rows.count() / 2)
    return LogisticRegression(maxIter=50, regParam=reg, standardization=False, featuresCol="features", labelCol="label", weightCol="weight").fit(_features(scaled, "url").repartition(1))


def judge(pages: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of pages.

    verdict is the longest fitting rule's, else block where the model's probability of
    an unwanted url is 0.5 or more (a tie blocks). A null or empty url, or one without
    host or path, is judged by the model from its empty parts. Repeated rows stay, a null
    page_id stays null, no rows give none; other columns are not read, whatever their names.
    """
    rows = _features(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    scored = model.transform(rows).select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"), vector_to_array("probability")[1].alias("score"))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
