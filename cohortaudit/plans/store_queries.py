"""Queries that write tables to files, read them again, and report on the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortaudit.functions import values as V
from cohortaudit.operators import audit as A
from cohortaudit.operators import joins as J
from cohortaudit.operators.audit import count_if
from cohortaudit.plans.inputs import IMAGES, PREDICTIONS, images, predictions, table
from cohortaudit.plans.book import query
from cohortaudit.plans.risk_queries import C0, _c0
from cohortaudit.sources import tables as T
from cohortaudit.sources.scratch import scratch


@query("s2_read_strings", "select c_custkey::varchar as c_custkey, nullif(case when c_custkey % 3 = 0 then '' else c_mktsegment end, '') as segment from customer")
def s2(spark, sf):
    path = scratch(spark, "strings")
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    table(spark, sf, "customer").select("c_custkey", segment.alias("segment")).write.csv(path, header=True)
    return T.read_strings(spark, path, ["c_custkey", "segment"])


@query("s3_read_labels", "select doc_id::varchar as doc_id, quality::double as quality, case when doc_id % 4 > 0 then toxic::double end as toxic from labels")
def s3(spark, sf):
    path = scratch(spark, "labels")
    table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality", F.when(F.col("doc_id") % 4 > 0, F.col("toxic")).alias("toxic")).write.json(path)
    return T.read_labels(spark, path, "doc_id", ["quality", "toxic"])


@query("s4_read_reports", "select doc_id as study_id, text from documents where text is not null")
def s4(spark, sf):
    folder = scratch(spark, "reports")
    T.write_reports(table(spark, sf, "documents"), folder, "doc_id", "text")
    return T.read_reports(spark, folder).select("study_id", "text")


@query("s6_write_aggregate", "select lang, count(*) as n from documents group by 1")
def s6(spark, sf):
    path = scratch(spark, "aggregate")
    T.write_aggregate(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), path, ["lang", "n"], "parquet")
    return spark.read.parquet(path)


@query("d8_shareable_set", "select source, count(*) as n, round(avg(n_chars), 6) as mean from documents group by 1")
def d8(spark, sf):
    path = scratch(spark, "shareable")
    got = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
    T.write_aggregate(got, path, ["source", "n", "mean"], "parquet")
    return spark.read.parquet(path)


@query("s7_prediction_store", f"with {PREDICTIONS} select study, target, p from predictions where site = 'external' and model = 'm2'")
def s7(spark, sf):
    path = scratch(spark, "passes")
    rows = predictions(spark, sf).select("study", "target", "p", "site", "model").withColumns({"condition": F.lit("C0"), "label_source": F.lit("primary"), "threshold": F.lit(3), "seed": F.lit(1)})
    T.save_predictions(rows, path, "digest-1")
    return T.load_predictions(spark, path, "digest-1", site="external", model="m2", condition="C0", threshold=3).select("study", "target", "p")


@query("a48_dry_run", f"""with {IMAGES}, p as (select case when number = 1 then replace(path, '/patient', '/p') else path end as path, study from images),
f as (select count(*) as rows, count(*) filter (not regexp_matches(path, '^([^/]+)/(patient[0-9]+)/(study[0-9]+)/([^/]+)$')) as parse_failures, count(distinct case when regexp_matches(path, '^([^/]+)/(patient[0-9]+)/(study[0-9]+)/([^/]+)$') then regexp_extract(path, '/(patient[0-9]+/study[0-9]+)/', 1) end) as studies from p),
a as (select study as k, count(*) as a from images group by 1), b as (select o_orderkey as k, 1 as b from orders where o_orderkey % 5 > 0), j as (select coalesce(a, 0) as a, coalesce(b, 0) as b from a full join b on a.k = b.k),
s as (select count(*) filter (a > 0 and b > 0) as matched, count(*) filter (b = 0) as main_only, count(*) filter (a = 0) as label_only from j) select * from f, s""")
def a48(spark, sf):
    rows = images(spark, sf)
    path = F.when(F.col("number") == 1, F.replace("path", F.lit("/patient"), F.lit("/p"))).otherwise(F.col("path"))
    keys = rows.select(V.study_key(path).alias("key"))
    found = keys.agg(F.count("*").alias("rows"), count_if(F.col("key").isNull()).alias("parse_failures"), F.count_distinct("key").alias("studies"))
    labels = table(spark, sf, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("study"))
    joined = J.join_statistics(rows.select("study"), labels, "study").select("matched", "main_only", "label_only")
    return found.join(F.broadcast(joined))  # one row each


@query("r2_evaluable_error", f"with {C0} select site, model, round(avg(error), 6) as error, count(*) filter (error is null) as unlabelled from c0 group by 1, 2")
def r2(spark, sf):
    return _c0(spark, sf).groupBy("site", "model").agg(F.round(F.avg("error"), A.DIGITS).alias("error"), count_if(F.col("error").isNull()).alias("unlabelled"))
