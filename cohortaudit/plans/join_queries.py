"""Queries of joins, set comparisons and table sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortaudit.operators import joins as J
from cohortaudit.plans.inputs import IMAGES, LABELLED, STUDIES, images, labelled, studies, table
from cohortaudit.plans.book import query
from cohortaudit.sources import tables as T
from cohortaudit.sources.scratch import scratch
from cohortaudit.streaming import answers


@query("s1_read_table", "select count(*) as n, min(o_orderkey) as least, max(o_orderkey) as most from orders")
def s1(spark, sf):
    return T.read_table(spark, f"{sf}/orders.parquet").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


@query("s5_read_columns", "select doc_id, lang from documents")
def s5(spark, sf):
    return T.read_columns(spark, f"{sf}/documents.parquet", ["doc_id", "lang"])


@query("s9_verify_checksums", """with m as (select sha256(url) as sha256, 'p' || page_id as name from pages where page_id % 10 <> 9), f as (select 'p' || page_id as name, case when page_id % 10 = 8 then null when page_id % 10 = 7 then sha256(url || '!') else sha256(url) end as sha256 from pages where page_id % 10 <> 6)
select coalesce(m.name, f.name) as name, case when f.name is null then 'missing' when m.name is null then 'unlisted' when f.sha256 is null then 'unreadable' when m.sha256 = f.sha256 then 'verified' else 'mismatch' end as status from m full join f on m.name = f.name""")
def s9(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id") % 10
    lines = p.where(k != 9).select(F.concat(F.sha2("url", 256), F.lit("  p"), F.col("page_id")).alias("value"))
    digest = F.when(k == 8, F.lit(None)).when(k == 7, F.sha2(F.concat("url", F.lit("!")), 256)).otherwise(F.sha2("url", 256))
    return T.verify_checksums(T.parse_manifest(lines), p.where(k != 6).select(F.concat(F.lit("p"), F.col("page_id")).alias("name"), digest.alias("sha256")))


@query("s10_access_gate", "select 'FAIL' as status, 'reports' as missing from pages limit 1")
def s10(spark, sf):
    files = table(spark, sf, "pages").select(T.classify(F.col("url"), [("images", r"/en/"), ("labels", r"/(de|fr)/"), ("reports", r"\.never$")]).alias("category"))
    return T.access_gate(files, ["images", "labels", "reports"])


@query("s8_inventory_summary", """with f as (select url as name, length(html) as size, case when regexp_matches(lower(url), '/en/') then 'images' when regexp_matches(lower(url), '/de/') then 'labels' else 'other' end as category from pages)
select category, count(*) as files, sum(size)::bigint as bytes, count(distinct regexp_extract(name, '\\.([^.]+)$', 1)) as extensions from f group by 1""")
def s8(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("url").alias("name"), F.length("html").cast("long").alias("size"), T.classify(F.col("url"), [("images", "/en/"), ("labels", "/de/")]).alias("category"))
    return T.inventory_summary(rows)


@query("s11_latest_answers", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def s11(spark, sf):
    return T.latest_answers(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("s11_followed", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def s11c(spark, sf):
    last = (["user_id", "event_type"], "ts", "event_id")
    log, path = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value"), scratch(spark, "answers")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    # five batches; some come twice, as after a stop, and four are united on the way
    for number in (0, 1, 1, 2, 3, 2, 4):
        answers.save_batch(log.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == number), number, path, *last)
        if number == 3:
            answers.compact(spark, path, schema, *last)
    return answers.stored(spark, path, schema, *last).drop("ts")


@query("s11_next_position", "with o as (select c_nationkey as reader, c_custkey as item, row_number() over (partition by c_nationkey order by c_custkey) as position from customer), d as (select distinct reader, item from o where item % 4 <> 0 or reader = 3), l as (select reader, min(position) as next from o anti join d using (reader, item) group by 1) select reader, next from (select distinct reader from o) left join l using (reader)")
def s11b(spark, sf):
    from pyspark.sql import Window

    order = table(spark, sf, "customer").select(F.col("c_nationkey").alias("reader"), F.col("c_custkey").alias("item")).withColumn("position", F.row_number().over(Window.partitionBy("reader").orderBy("item")).cast("long"))
    return T.next_position(order, order.where("item % 4 <> 0 or reader = 3"), "reader", "item", "position")


@query("j1_join_statistics", "with a as (select l_orderkey as k, count(*) as a from lineitem where l_orderkey % 3 > 0 group by 1), b as (select o_orderkey as k, count(*) as b from orders where o_orderkey % 5 > 0 group by 1), j as (select coalesce(a, 0) as a, coalesce(b, 0) as b from a full join b on a.k = b.k) select sum(a)::bigint as main_rows, sum(b)::bigint as label_rows, count(*) filter (a > 1) as main_duplicates, count(*) filter (b > 1) as label_duplicates, count(*) filter (a > 0 and b > 0) as matched, count(*) filter (b = 0) as main_only, count(*) filter (a = 0) as label_only, round(sum(a * greatest(b, 1)) / sum(a)::double, 6) as expansion from j")
def j1(spark, sf):
    a = table(spark, sf, "lineitem").where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("k"))
    return J.join_statistics(a, table(spark, sf, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("k")), "k")


@query("j1_join_labels", "select d.doc_id, d.lang, quality, toxic from documents d left join labels using (doc_id)")
def j1b(spark, sf):
    return J.join_labels(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").withColumn("lang", F.lit("x")), "doc_id")


@query("j2_audit_chain", f"with {STUDIES} select s.study, s.patient, m.segment, p.split from studies s join (select l_orderkey as study from lineitem group by 1 having count(*) > 3) l using (study) left join (select study, segment from studies where study % 2 = 0) m using (study) left join (select study, split from studies where study % 3 = 0) p using (study)")
def j2(spark, sf):
    s = studies(spark, sf)
    labels = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("study")).count().where("count > 3").select("study")
    reports = s.select("study", F.when(F.col("study") % 4 > 0, F.col("patient")).alias("patient"))
    return J.audit_chain(reports, labels.join(s.select("study", "patient"), "study"), s.where("study % 2 = 0").select("study", "segment"), s.where("study % 3 = 0").select("study", "split"))


@query("j3_image_manifest", f"with {IMAGES} select study, file, price from images join (select o_orderkey as study, o_totalprice as price from orders where o_orderstatus = 'F') using (study)")
def j3(spark, sf):
    s = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("study"), F.col("o_totalprice").alias("price"))
    return images(spark, sf).select("study", "file").join(s, "study")


@query("j4_agreement", "with a as (select o_orderkey as k, o_custkey as x from orders), b as (select o_orderkey as k, case when o_orderkey % 50 = 0 then null else o_custkey end as y from orders) select count(*) as matched, count(*) filter (x is distinct from y) as differing, bool_and(x is not distinct from y) as agree from a join b using (k)")
def j4(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("x"))
    return J.agreement(o, o.withColumn("x", F.when(F.col("k") % 50 > 0, F.col("x"))), "k", "x")


_PAIRS = (("lineitem-orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders-lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("orders-customer", "orders", "o_custkey", "customer", "c_custkey"), ("customer-orders", "customer", "c_custkey", "orders", "o_custkey"), ("labels-documents", "labels", "doc_id", "documents", "doc_id"), ("documents-labels", "documents", "doc_id", "labels", "doc_id"), ("lineitem-part", "lineitem", "l_partkey", "part", "p_partkey"), ("lineitem-supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer-nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("nation-region", "nation", "n_regionkey", "region", "r_regionkey"))


@query("j5_reference_checks", " union all ".join(f"select '{n}' as pair, count(*) as keys, count(*) filter (p is null) as unmatched from (select distinct {ck} as k from {c}) left join (select distinct {pk} as p from {p}) on k = p" for n, c, ck, p, pk in _PAIRS))
def j5(spark, sf):
    return J.reference_checks([(n, table(spark, sf, c), ck, table(spark, sf, p), pk) for n, c, ck, p, pk in _PAIRS])


@query("j6_hierarchy", "with c as (select l_orderkey as k, count(distinct l_suppkey % 2) as n from lineitem group by 1), p as (select o_orderkey as k from orders where o_orderkey % 9 > 0) select count(*) filter (p.k is null) as orphans, count(*) filter (c.k is null) as childless, count(*) filter (n > 1) as several_parents from c full join p on c.k = p.k")
def j6(spark, sf):
    child = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 2).alias("g"))
    return J.hierarchy_checks(child, table(spark, sf, "orders").where("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("k")), "k", "g")


@query("j7_semi_join", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def j7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("j8_donor_labels", "select d.doc_id, l.toxic as donor_v from documents d left join labels l using (doc_id)")
def j8(spark, sf):
    return J.donor_labels(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "toxic")


@query("j10_align_exact", f"with {STUDIES} select study, patient, price from studies where split = 'evaluation'")
def j10(spark, sf):
    s = studies(spark, sf)
    return J.align(s.select("study", "patient", "price"), s.where("split = 'evaluation'").select("study", "patient"), "study", "patient")


@query("j10_align_common", f"with {STUDIES} select study, patient, price from studies where study % 3 = 0 and study % 2 = 0")
def j10b(spark, sf):
    s = studies(spark, sf)
    return J.align(s.where("study % 3 = 0").select("study", "patient", "price"), s.where("study % 2 = 0").select("study", "patient"), "study", "patient", exact=False)


@query("j11_cohort_difference", "select count(*) filter (o_orderkey % 10 = 1 and o_orderkey % 7 <> 2) as only_a, count(*) filter (o_orderkey % 7 = 2 and o_orderkey % 10 <> 1) as only_b, count(*) filter (o_orderkey % 10 <> 1 and o_orderkey % 7 <> 2 and o_orderkey % 13 = 5) as differing from orders")
def j11(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    a = o.where("o_orderkey % 7 <> 2")
    b = o.where("o_orderkey % 10 <> 1").withColumn("o_custkey", F.when(F.col("o_orderkey") % 13 != 5, F.col("o_custkey")))
    return J.cohort_difference(a, b, "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("j12_pair_tables", f"with {LABELLED}, a as (select cluster, count(*)::double as n, round(avg((quality = 1)::int), 6) as share from labelled where site = 'en' group by 1), b as (select cluster, count(*)::double as n, round(avg((quality = 1)::int), 6) as share from labelled where site = 'fr' group by 1) select coalesce(a.cluster, b.cluster) as cluster, a.n as n_a, b.n as n_b, round(b.n - a.n, 6) as n_difference, a.share as share_a, b.share as share_b, round(b.share - a.share, 6) as share_difference from a full join b on a.cluster = b.cluster")
def j12(spark, sf):
    per = lambda s: labelled(spark, sf).where(F.col("site") == s).groupBy("cluster").agg(F.count("*").cast("double").alias("n"), F.round(F.avg(F.when(F.col("quality") == 1, 1.0).when(F.col("quality").isNotNull(), 0.0)), 6).alias("share"))
    return J.pair_tables(per("en"), per("fr"), "cluster", ["n", "share"])


@query("j13_same_sets", """with a as (select distinct l_orderkey as k from lineitem), b as (select o_orderkey as k from orders), c as (select o_orderkey as k from orders where o_orderkey % 2 = 0),
f as (select 'lineitem' as a, 'orders' as b, (select count(*) from a anti join b using (k)) as only_a, (select count(*) from b anti join a using (k)) as only_b union all
select 'lineitem', 'even', (select count(*) from a anti join c using (k)), (select count(*) from c anti join a using (k)) union all
select 'orders', 'even', (select count(*) from b anti join c using (k)), (select count(*) from c anti join b using (k)))
select a, b, only_a, only_b, only_a + only_b = 0 as equal, only_a = 0 as a_in_b from f""")
def j13(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return J.same_sets([("lineitem", table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))), ("orders", o), ("even", o.where("k % 2 = 0"))], "k")


@query("j14_expert_reference", "select l_orderkey as study, max((l_quantity > 40)::int) as a, max((l_discount > 0.08)::int) as b from lineitem group by 1")
def j14(spark, sf):
    flag = lambda c: F.when(c, 1).otherwise(0)
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("study"), flag(F.col("l_quantity") > 40).alias("a"), flag(F.col("l_discount") > 0.08).alias("b"))
    return J.expert_reference(rows, "study", ["a", "b"])


@query("j15_find_lost", "select o_custkey % 20 as lost, count(*) filter (o_custkey % 20 > 4 and o_orderkey % 3 = 0) as differences from orders group by 1")
def j15(spark, sf):
    o = table(spark, sf, "orders")
    value = F.when((F.col("o_custkey") % 20 > 4) & (F.col("o_orderkey") % 3 == 0), -1.0).otherwise(F.col("o_totalprice"))
    found = o.select((F.col("o_custkey") % 20).alias("lost"), F.col("o_orderkey").alias("k"), value.alias("v"))
    return J.find_lost(found, o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), "k", "v")


@query("u1_union", "select o_orderkey as study, c as condition from orders cross join (values ('C0'), ('C1'), ('C2')) t(c)")
def u1(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("study"))
    frames = [o.withColumn("condition", F.lit(c)) for c in ("C0", "C1", "C2")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("u2_set_equality", "select count(*) = 0 as equal from ((select c_custkey from customer except select o_custkey from orders) union all (select o_custkey from orders except select c_custkey from customer))")
def u2(spark, sf):
    a, b = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey")
    return a.subtract(b).union(b.subtract(a)).agg((F.count("*") == 0).alias("equal"))


@query("u3_differences", "select (select count(*) from (select c_custkey from customer except select o_custkey from orders)) as only_left, (select count(*) from (select c_custkey from customer intersect select o_custkey from orders)) as common")
def u3(spark, sf):
    a, b = table(spark, sf, "customer").select("c_custkey").distinct(), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("there", F.lit(True))
    return a.join(b, "c_custkey", "left").agg(F.count_if(F.col("there").isNull()).alias("only_left"), F.count_if(F.col("there")).alias("common"))


@query("u4_subset", "select count(*) = 0 as contained from (select l_orderkey from lineitem anti join orders on l_orderkey = o_orderkey)")
def u4(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey").join(o, "l_orderkey", "left_anti").agg((F.count("*") == 0).alias("contained"))


@query("w12_total_order", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1")
def w12(spark, sf):
    return J.first_in_order(table(spark, sf, "orders"), "o_custkey", F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")
