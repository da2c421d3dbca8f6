"""Queries of contracts, leak checks, cohorts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortaudit.functions import text as X
from cohortaudit.functions import values as V
from cohortaudit.operators import cohort as C
from cohortaudit.operators import contracts as D
from cohortaudit.operators import sections as S
from cohortaudit.plans.audit_queries import EFFECTIVE
from cohortaudit.plans.inputs import IMAGES, PREDICTIONS, STUDIES, images, predictions, reports, sql_hash, studies, table
from cohortaudit.plans.book import query
from cohortaudit.plans.section_queries import PARSED


@query("a18_profile", " union all ".join(f"select '{c}' as column, count(*) as rows, count(*) filter ({c} is null) as nulls, count(*) filter (trim({c}::varchar) = '') as blanks, count(distinct {c}) as distinct, count(distinct {c}) = count(*) and count({c}) = count(*) as unique from documents" for c in ("doc_id", "lang", "source")))
def a18(spark, sf):
    return D.profile(table(spark, sf, "documents"), ["doc_id", "lang", "source"])


@query("a18_duplicate_rows", "with g as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1) select count(*) as groups, coalesce(sum(n - 1), 0)::bigint as extra from g")
def a18b(spark, sf):
    return D.duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("a19_key_checks", "with r as (select count(*) filter (o_orderkey is null) as null_keys, bool_and(regexp_full_match(o_orderstatus, '[FOP]')) as o_orderstatus_format, bool_and(regexp_full_match(o_orderpriority, '[1-3].*')) as o_orderpriority_format from orders), k as (select count(*) as repeated_keys from (select o_orderkey from orders group by 1 having count(*) > 1)) select *, null_keys = 0 and repeated_keys = 0 as is_key from r, k")
def a19(spark, sf):
    return D.key_checks(table(spark, sf, "orders"), ["o_orderkey"], {"o_orderstatus": "[FOP]", "o_orderpriority": "[1-3].*"})


@query("a20_path_checks", f"with {IMAGES}, p as (select path, patient::varchar as patient, case when number = 4 then 'x' else study::varchar end as study from images) select count(*) as rows, count(*) filter (regexp_matches(path, 'patient([0-9]+)/study([0-9]+)/')) as matching, bool_and(regexp_extract(path, 'patient([0-9]+)/study([0-9]+)/', 1) = patient) as patient_agrees, bool_and(regexp_extract(path, 'patient([0-9]+)/study([0-9]+)/', 2) = study) as study_agrees from p")
def a20(spark, sf):
    rows = images(spark, sf).withColumn("study", F.when(F.col("number") == 4, "x").otherwise(F.col("study").cast("string")))
    return D.path_checks(rows, "path", "patient([0-9]+)/study([0-9]+)/", ["patient", "study"])


_ROLES = "roles as (select case when o_orderkey % 2 = 0 then o_custkey end as a, case when o_orderkey % 3 = 0 then o_custkey % 50 end as b from orders)"


@query("a21_role_coverage", f"with {_ROLES}, " + "f as (select 'a' as role, a as v from roles union all select 'b', b from roles) select role, count(v) as populated, count(*) filter (v is null) as null, round(count(v) / count(*)::double, 6) as coverage, count(distinct v) as distinct from f group by role union all select 'any', count(coalesce(a, b)), count(*) filter (coalesce(a, b) is null), round(count(coalesce(a, b)) / count(*)::double, 6), (select count(distinct v) from f) from roles")
def a21(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.when(k % 2 == 0, F.col("o_custkey")).alias("a"), F.when(k % 3 == 0, F.col("o_custkey") % 50).alias("b"))
    return D.role_coverage(rows, ["a", "b"])


@query("a22_group_sizes", "with n as (select o_custkey, count(*) as n from orders group by 1) select count(*) as groups, min(n) as least, round(avg(n), 6) as mean, max(n) as most, quantile_cont(n, 0.25) as p25, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.75) as p75, quantile_cont(n, 0.95) as p95, quantile_cont(n, 0.99) as p99 from n")
def a22(spark, sf):
    return D.group_sizes(table(spark, sf, "orders"), "o_custkey")


@query("a22_size_histogram", "select size, count(*) as groups from (select o_custkey, count(*) as size from orders group by 1) group by 1")
def a22b(spark, sf):
    return D.size_histogram(table(spark, sf, "orders"), "o_custkey")


@query("a23_member_audit", """with f as (select case when page_id % 20 = 0 then 'a/readme' else 'p/q' || page_id % 3 || '/s' || page_id || '.txt' end as name, case when page_id % 7 = 0 then 0 else length(html) end as size, page_id from pages),
o as (select count(*) filter (page_id % 20 > 0) as named, count(*) filter (page_id % 20 = 0) as others, min(len(string_split(name, '/')) - 1)::int as least_depth, max(len(string_split(name, '/')) - 1)::int as most_depth, min(size) as least_size, round(avg(size), 6) as mean_size, max(size) as most_size, count(*) filter (size = 0) as empty from f),
t as (select count(*) as repeated from (select name from f group by 1 having count(*) > 1)),
s as (select count(*) filter (f.page_id is null) as missing, count(*) filter (e.page_id is null) as beyond from (select page_id from f where page_id % 20 > 0) f full join (select page_id from pages where page_id % 9 > 0) e on f.page_id = e.page_id)
select * from o, t, s""")
def a23(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    name = F.when(k % 20 == 0, "a/readme").otherwise(F.concat(F.lit("p/q"), k % 3, F.lit("/s"), k, F.lit(".txt")))
    files = p.select(name.alias("name"), F.when(k % 7 == 0, 0).otherwise(F.length("html")).cast("long").alias("size"))
    return D.member_audit(files, p.where("page_id % 9 > 0").select(k.alias("id")), r"s([0-9]+)\.txt")


@query("a34_split_integrity", f"with {STUDIES} select count(*) filter (n > 1) as patients_in_several, (select count(*) from studies where not (site = 'source' or split = 'evaluation')) as forbidden_rows from (select patient, count(distinct split) as n from studies group by 1)")
def a34(spark, sf):
    return D.split_isolation(studies(spark, sf), "patient", "split", "site", {"source": ["train", "calibration", "evaluation"], "external": ["evaluation"]})


_CONTRACT = PREDICTIONS + """, c as (select site, split, patient::varchar as patient, study::varchar as study, study || '-' || model || '-' || target as image, coalesce(y, 2.0)::int as label, case when study % 101 = 0 then 1.5 else p end as p, case when study % 4 = 0 then '' else 'x' end as context, case when study % 8 = 0 then 'absent' else 'informative' end as state from predictions)"""


@query("d1_contract", f"""with {_CONTRACT} select 'blank:patient' as rule, count(*) filter (trim(patient) = '') as violations from c union all select 'label:label', count(*) filter (label not in (0, 1)) from c union all select 'probability:p', count(*) filter (not (p between 0 and 1)) from c
union all select 'domain:site', count(*) filter (site not in ('source')) from c union all select 'state', count(*) filter ((context = '' and state <> 'absent') or (context <> '' and state = 'absent')) from c
union all select 'repeated', count(*) from (select image from c group by 1 having count(*) > 1) union all select 'parent:study', count(*) from (select study from c group by 1 having count(distinct patient) > 1) union all select 'parent:patient', count(*) from (select patient from c group by 1 having count(distinct split) > 1)""")
def d1(spark, sf):
    s = F.col("study")
    rows = predictions(spark, sf).select(
        "site", "split", F.col("patient").cast("string").alias("patient"), F.concat_ws("-", s, "model", "target").alias("image"), F.coalesce("y", F.lit(2.0)).cast("int").alias("label"), F.when(s % 101 == 0, 1.5).otherwise(F.col("p")).alias("p"),
        F.when(s % 4 == 0, "").otherwise("x").alias("context"), F.when(s % 8 == 0, "absent").otherwise("informative").alias("state"), s.cast("string").alias("study"),
    )
    return D.contract_violations(rows, ["patient"], "image", [("study", "patient"), ("patient", "split")], ["label"], ["p"], "context", "state", {"site": ["source"]})


@query("d2_split_isolation", f"with {STUDIES} select count(*) filter (n > 1) as patients_in_several, (select count(*) from studies where not (site = 'external' or split = 'train')) as forbidden_rows from (select patient, count(distinct split) as n from studies group by 1)")
def d2(spark, sf):
    return D.split_isolation(studies(spark, sf), "patient", "split", "site", {"source": ["train"], "external": ["train", "calibration", "evaluation"]})


@query("d3_markers", "select m as marker, (select count(*) from documents where contains(upper(text), m)) as rows from (values ('TABLE:'), ('THE'), ('LICENSE')) t(m)")
def d3(spark, sf):
    return D.marker_counts(table(spark, sf, "documents"), "text", ("TABLE:", "THE", "LICENSE"))


_LEAKS = {"mail": "[a-z0-9.]+@[a-z0-9.]+", "token": "(?i)password|akia", "path": "/s[0-9]+/"}


@query("d4_leak_scan", "with f as (select 'lang' as \"column\", lang as v from documents union all select 'source', source from documents union all select 'text', text from documents), c as (" + " union all ".join(f"select \"column\", '{k}' as pattern, count(*) filter ({cond}) as cells from f group by 1" for k, cond in [*((k, f"regexp_matches(v, '{p}')") for k, p in _LEAKS.items()), ("long_text", "length(v) > 200")]) + ") select * from c where cells > 0")
def d4(spark, sf):
    return D.leak_scan(table(spark, sf, "documents"), _LEAKS)


@query("d5_payload_scan", "select count(*) filter (event_id % 3 = 0) as key_rows, count(*) filter (event_type = 'click') as value_rows from events")
def d5(spark, sf):
    nested = F.when(F.col("event_id") % 3 == 0, F.struct(F.struct(F.col("user_id").alias("patient_id"), F.lit(None).cast("long").alias("n")).alias("x"), F.col("event_type").alias("kind"))).otherwise(F.struct(F.struct(F.lit(None).cast("long").alias("patient_id"), F.col("event_id").alias("n")).alias("x"), F.col("event_type").alias("kind")))
    return D.payload_scan(table(spark, sf, "events").select(nested.alias("p")), "p", ["patient_id"], '"click"')


@query("d6_checks", "with c as (select case when (select count(*) from orders where o_totalprice < 0) = 0 then 'PASS' else 'FAIL' end as status union all select case when (select count(*) from documents where text like '%AKIA%') = 0 then 'PASS' else 'WARN' end union all select case when (select count(*) from labels where quality = 1) = 0 then 'PASS' else 'FAIL' end) select status, count(*) as checks from c group by 1")
def d6(spark, sf):
    rows = D.empty_checks(spark)
    rows = rows.unionByName(D.check_row(table(spark, sf, "orders"), "price", "range", "orders", F.count_if(F.col("o_totalprice") < 0)))
    rows = rows.unionByName(D.check_row(table(spark, sf, "documents"), "keys", "leak", "documents", F.count_if(F.contains("text", F.lit("AKIA"))), "warning"))
    rows = rows.unionByName(D.check_row(table(spark, sf, "labels"), "quality", "domain", "labels", F.count_if(F.col("quality") == 1)))
    return D.check_summary(rows)


@query("d7_form_violations", "with r as (select event_id, case when event_id % 5 = 0 then '' else event_type end as quality, case when event_id % 7 = 0 then 'odd' else 'good' end as projection from events) select event_id, case when quality = '' and projection = 'odd' then 'projection,quality' when quality = '' then 'quality' when projection = 'odd' then 'projection' else '' end as violations from r")
def d7(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(k, F.when(k % 5 == 0, "").otherwise(F.col("event_type")).alias("quality"), F.when(k % 7 == 0, "odd").otherwise("good").alias("projection"))
    return D.form_violations(rows, ["quality"], {"projection": ["good"]}).select("event_id", "violations")


_ELIGIBLE = f"""{PARSED}, tok as (select doc_id, sum({EFFECTIVE.format('body')}) filter (section in ('indication', 'history')) as tokens, max((section = 'impression')::int) as impression from mapped group by 1),
base as (select r.doc_id, r.patient, r.lang, coalesce(tokens, 0)::bigint as tokens, coalesce(impression, 0) as impression from reports r left join tok using (doc_id)),
st as (select *, case when lang not in ('en', 'fr', 'de') then 1 when tokens < 1 then 2 when tokens < 3 then 3 when impression = 0 then 4 else 5 end as step from base)"""


def _base(spark, sf):
    r = reports(spark, sf)
    parsed = S.parse_sections(r, "report", ["doc_id"], S.section_map(spark))
    tok = parsed.groupBy("doc_id").agg(F.sum(F.when(F.col("section").isin("indication", "history"), X.effective_tokens("body"))).alias("tokens"), F.max(F.when(F.col("section") == "impression", 1).otherwise(0)).alias("impression"))
    return r.select("doc_id", "patient", "lang").join(tok, "doc_id", "left").na.fill(0, ["tokens", "impression"])


def _steps():
    return [("language", F.col("lang").isin("en", "fr", "de")), ("context", F.col("tokens") >= 1), ("tokens", F.col("tokens") >= 3), ("impression", F.col("impression") == 1)]


@query("a32_waterfall", f"with {_ELIGIBLE}, n as (select i as step, name, (select count(*) from st where step = i) as removed, (select count(*) from st where step >= i) as before from (values (1, 'language'), (2, 'context'), (3, 'tokens'), (4, 'impression')) t(i, name)) select step, name, before, removed, before - removed as after, round((before - removed) / (select count(*) from st)::double, 6) as fraction from n")
def a32(spark, sf):
    return C.waterfall(_base(spark, sf), _steps())


@query("c1_eligible", f"with {_ELIGIBLE} select doc_id, tokens from st where step = 5")
def c1(spark, sf):
    return C.eligible(_base(spark, sf), _steps()).select("doc_id", "tokens")


@query("a33_view_distribution", f"with {IMAGES} select view, count(*) as images, count(distinct study) as studies from images group by 1")
def a33(spark, sf):
    return C.view_distribution(images(spark, sf), "view", "study")


@query("a33_split_sensitivity", f"with {_ELIGIBLE} select lang, count(*) as rows, count(distinct patient) as patients, " + ", ".join(f"count(*) filter (tokens >= {t}) as rows_{t}, count(distinct case when tokens >= {t} then patient end) as patients_{t}" for t in (3, 5, 10)) + " from base group by 1")
def a33b(spark, sf):
    return C.split_sensitivity(_base(spark, sf), "lang", "patient", "tokens", [3, 5, 10])


_TIERS = STUDIES + """, picked as (select patient, row_number() over (order by md5('7:' || patient), patient) as n from (select distinct patient from studies where split = 'train')),
tiers as (select s.*, case when split <> 'train' then 'official_' || split when n <= 200 then 'eval' when n <= 320 then 'calibration' else 'train' end as tier from studies s left join picked using (patient))"""


def _tiers(spark, sf):
    return C.assign_tiers(studies(spark, sf), "patient", "split", "train", 200, 120, "7")


@query("c2_tiers", f"with {_TIERS} select study, tier from tiers")
def c2(spark, sf):
    return _tiers(spark, sf).select("study", "tier")


@query("c3_split_validation", f"with {STUDIES}, p as (select patient, row_number() over (order by md5('9:' || patient), patient) as n from (select distinct patient from studies)), k as (select greatest(1, round_even(0.1 * count(distinct patient), 0)) as k from studies) select study, case when n <= k then 'validation' else 'train' end as part from studies join p using (patient), k")
def c3(spark, sf):
    return C.split_validation(studies(spark, sf), "patient", 0.1, "9").select("study", "part")


@query("a35_tier_summary", f"with {_TIERS} select tier, count(distinct patient) as patients, count(distinct study) as studies, count(*) as rows from tiers group by 1")
def a35(spark, sf):
    return C.tier_summary(_tiers(spark, sf), "tier", "patient", "study")


@query("a35_tier_disjoint", f"with {_TIERS} select count(*) filter (n > 1) as shared, count(*) filter (n > 1) = 0 as disjoint from (select patient, count(distinct tier) as n from tiers group by 1)")
def a35b(spark, sf):
    return C.tier_disjoint(_tiers(spark, sf), "tier", "patient")


@query("a36_budgets", f"with {STUDIES}, p as (select patient, row_number() over (order by md5('5:' || patient), patient) as rank from (select distinct patient from studies)), n as (select patient, rank, count(*) as n from studies join p using (patient) group by 1, 2), b as (select unnest([10, 50, 200]) as budget) select budget, count(*) as patients, sum(n)::bigint as studies from n join b on rank <= budget group by 1")
def a36(spark, sf):
    return C.budgets(studies(spark, sf), "patient", [10, 50, 200], "5")


_STRATA = STUDIES + f""", flags as (select study, {sql_hash("'l:' || study")} % 5 = 0 as l, {sql_hash("'a:' || study")} % 4 = 0 as a, {sql_hash("'c:' || study")} % 2 = 0 as p from studies),
strata as (select study, 'L' || l::int || 'A' || a::int || 'P' || p::int as stratum, case when l then 'disagree' when a then 'abstain' else 'other' end as group from flags)"""


def _strata(spark, sf):
    h = lambda k, m: V.portable_hash(F.lit(k), "study") % m == 0
    rows = studies(spark, sf).select("study", h("l", 5).alias("l"), h("a", 4).alias("a"), h("c", 2).alias("p"))
    code, group = C.stratum_code("l", "a", "p")
    return rows.select("study", code.alias("stratum"), group.alias("group"))


@query("c4_stratum_code", f"with {_STRATA} select study, stratum, \"group\" from strata")
def c4(spark, sf):
    return _strata(spark, sf)


_SHARES = {"disagree": 0.5, "abstain": 0.25, "other": 0.25}


# one round of largest remainders, as no stratum of the given tables has fewer rows than its part
@query("c5_allocate", f"""with {_STRATA}, c as (select stratum, "group", count(*) as n from strata group by 1, 2),
r as (select *, 200 * case "group" when 'disagree' then 0.5 else 0.25 end::double as want, sum(n) over (partition by "group") as total from c),
f as (select *, want * n / total as ideal, floor(want * n / total) as whole from r),
k as (select *, row_number() over (partition by "group" order by ideal - whole desc, n desc, stratum desc) as place, want - sum(whole) over (partition by "group") as rest from f)
select stratum, "group", n, (whole + (place <= rest)::int)::int as size from k""")
def c5(spark, sf):
    counts = _strata(spark, sf).groupBy("stratum", "group").agg(F.count("*").alias("n"))
    return counts.join(spark.createDataFrame(sorted(C.allocate(counts, 200, _SHARES).items()), "stratum string, size int"), "stratum")


@query("c6_draw", f"with {_STRATA}, r as (select *, row_number() over (partition by stratum order by md5('3:' || study), study) as n, count(*) over (partition by stratum) as k from strata) select study, stratum, round(20 / k::double, 6) as probability from r where n <= 20 and \"group\" <> 'other'")
def c6(spark, sf):
    rows = _strata(spark, sf).where("group <> 'other'")
    sizes = {f"L{a}A{b}P{c}": 20 for a in "01" for b in "01" for c in "01" if a + b != "00"}
    return C.draw(rows, "stratum", "study", sizes, "3").select("study", "stratum", "probability")


@query("c7_reading_order", "with i as (select doc_id as item, doc_id % 50 = 0 as practice from documents) select reader, item, row_number() over (partition by reader order by practice desc, md5('s:' || reader || ':' || item), item) as position from i cross join (values ('r1'), ('r2')) t(reader)")
def c7(spark, sf):
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), (F.col("doc_id") % 50 == 0).alias("practice"))
    return C.reading_order(items, ["r1", "r2"], "item", "practice", "s")


@query("c8_download_list", f"with {IMAGES} select distinct split, path from images where view = 'Frontal' order by split, path")
def c8(spark, sf):
    return C.download_list(images(spark, sf).where("view = 'Frontal'"), "split", "path")


_DESIGN = STUDIES + ", m as (select split, patient, count(*) * 0.8::double as m from studies group by 1, 2), d as (select split, sum(m) as n, sum(m * m) / sum(m) as a from m group by 1), e as (select split, round(n, 6) as n, round(a, 6) as m_adj, round(1 + (greatest(a, 1.0) - 1) * 0.3::double, 6) as deff from d)"


@query("a45_design_effect", f"with {_DESIGN} select * from e")
def a45(spark, sf):
    return C.design_effect(studies(spark, sf), "split", "patient", 0.8, 0.3)


@query("r26_detectable", f"with {_DESIGN} select split, sd, round(sd * sqrt(deff / n), 6) as se_paired, round(sd * sqrt(deff / n) * sqrt(2.0), 6) as se_unpaired, round(sd * sqrt(deff / n) * 2.801585, 6) as mde from e cross join (values (0.1::double), (0.3::double)) t(sd)")
def r26(spark, sf):
    return C.detectable(C.design_effect(studies(spark, sf), "split", "patient", 0.8, 0.3), [0.1, 0.3])


@query("a47_distinct_states", f"with {_ELIGIBLE} select case when tokens = 0 then 'N3' when tokens < 3 then 'N2' else 'N1' end as state, count(distinct doc_id) as studies from base group by 1")
def a47(spark, sf):
    return C.distinct_states(_base(spark, sf).withColumn("state", X.natural_state("tokens")), "state", "doc_id")
