"""Queries of text functions and cohort audits over the documents and the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortaudit.functions import text as X
from cohortaudit.functions import values as V
from cohortaudit.operators import audit as A
from cohortaudit.operators.prefix import quantiles
from cohortaudit.plans.inputs import IMAGES, LABELLED, LABELLED_LONG, LEXICON, STUDIES, images, labelled, sql_hash, studies, table
from cohortaudit.plans.book import query

GENERIC = ["of the", "that"]
NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '_+', ' ', 'g'), '\\s+', ' ', 'g'))"
TOKENS = "len(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?'))::int"
LEAST = 40


def norm(text: str) -> str:
    return NORM.format(text)


def tokens(text: str) -> str:
    return TOKENS.format(text)


def _stripped(text: str) -> str:
    out = norm(text)
    for p in GENERIC:
        out = f"regexp_replace({out}, '\\b{p}\\b', ' ', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def low(text: str) -> str:
    return f"(case when {norm(text)} = '' then false else {tokens(norm(text))} < {LEAST} or {tokens(_stripped(text))} < {LEAST} end)"


CONTEXT = f"""context as (
  select *, norm <> '' as present, {tokens("norm")} as tokens, norm <> '' and low as low, norm <> '' and not low as usable,
    case when norm = '' then 'absent' when low then 'low_information' else 'usable' end as state
  from (select *, {norm("context")} as norm, {low("context")} as low from contexts))"""
#: Every whole text is a context; contexts of the other kinds (null, short, generic only) are rows of their own with ids below zero.
CONTEXTS = "contexts as (select *, text as context from labelled union all select * replace (-1 - doc_id as doc_id), case doc_id % 5 when 0 then null when 1 then cluster || ' ' || site else 'of the  that' end from labelled where doc_id % 5 < 3)"


def _contexts(spark, sf):
    rows = labelled(spark, sf)
    h = F.col("doc_id") % 5
    other = F.when(h == 0, F.lit(None)).when(h == 1, F.concat_ws(" ", "cluster", "site")).otherwise("of the  that")
    more = rows.where(h < 3).select("*", other.alias("context")).withColumn("doc_id", -1 - F.col("doc_id"))
    rows = rows.withColumn("context", F.col("text")).unionByName(more)
    return rows.withColumn("f", X.context_features("context", LEAST, GENERIC)).select("*", "f.*").drop("f")


def _has(w: str, cues) -> str:
    return "(" + " or ".join(f"contains({w}, '{c}')" for c in cues) + ")"


#: The phrases of each label and side, by a short name.
_SIDES = {"qd": LEXICON["quality"]["direct"], "qs": LEXICON["quality"]["synonym"], "td": LEXICON["toxic"]["direct"], "ts": LEXICON["toxic"]["synonym"]}


def _parts(side: str, phrase: str) -> str:
    """What precedes each occurrence of a phrase, with up to 45 parts before it, which hold 45 characters at least."""
    return f"""select doc_id, '{side}' as side, i, k, right(string_agg(right(part, 45), '{phrase}') over (partition by doc_id order by i rows between 45 preceding and current row), 45) as w
  from (select doc_id, unnest(ps) as part, generate_subscripts(ps, 1) as i, len(ps) as k from (select doc_id, regexp_split_to_array(s, '\\b{phrase}\\b') as ps from cued))"""


# The texts get cues put before some words, as no text of the tables has any.
MENTIONED = f"""cued as (select *, {norm("replace(replace(text, ' the ', ' no sign of the '), ' and ', ' possible and ')")} as s from labelled),
windows as (select doc_id, side, {_has("w", X.NEGATION_CUES)} as neg, {_has("w", X.SPECULATION_CUES)} as spec from ({" union all ".join(_parts(side, p) for side, ps in _SIDES.items() for p in ps)}) where i < k),
kinds as (select doc_id, side, bool_or(not neg and not spec) as affirmed, bool_or(neg) as negated, bool_or(not neg and spec) as speculative from windows group by 1, 2),
mentioned as (select c.*, {", ".join(f"{x}.doc_id is not null as {x}_any, coalesce({x}.affirmed, false) as {x}_affirmed, coalesce({x}.negated, false) as {x}_negated, coalesce({x}.speculative, false) as {x}_speculative" for x in _SIDES)}
  from cued c {" ".join(f"left join kinds {x} on c.doc_id = {x}.doc_id and {x}.side = '{x}'" for x in _SIDES)}),
mention_long as (
  select doc_id, 'quality' as label, quality as v, qd_any as d_any, qs_any as s_any, qd_affirmed or qs_affirmed as affirmed, qd_negated or qs_negated as negated, qd_speculative or qs_speculative as speculative from mentioned
  union all select doc_id, 'toxic', toxic, td_any, ts_any, td_affirmed or ts_affirmed, td_negated or ts_negated, td_speculative or ts_speculative from mentioned)"""


def _cued(spark, sf):
    s = F.replace(F.replace("text", F.lit(" the "), F.lit(" no sign of the ")), F.lit(" and "), F.lit(" possible and "))
    return labelled(spark, sf).withColumn("s", s)


def _mention_long(spark, sf):
    rows = _cued(spark, sf)
    out = None
    for label, lex in LEXICON.items():
        part = rows.select("doc_id", F.lit(label).alias("label"), F.col(label).alias("v"), X.mentions("s", lex["direct"]).alias("direct"), X.mentions("s", lex["synonym"]).alias("synonym"))
        out = part if out is None else out.unionByName(part)
    return out


def _long(spark, sf):
    return A.unpivot(labelled(spark, sf), ["quality", "toxic"])


def _context_long(spark, sf):
    return A.unpivot(_contexts(spark, sf).select("doc_id", "site", "cluster", "state", "usable", "quality", "toxic"), ["quality", "toxic"])


CONTEXT_LONG = """context_long as (select *, case when v = 1 then 'pos' when v = 0 then 'neg' when v = -1 then 'unc' else 'unm' end as label_state from (
  select doc_id, site, cluster, state, usable, 'quality' as label, quality as v from context union all select doc_id, site, cluster, state, usable, 'toxic', toxic from context))"""


@query("f1_normalize", f"select doc_id, {norm('text')} as s from documents")
def f1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize("text").alias("s"))


@query("f2_token_count", f"select doc_id, {tokens(norm('text'))} as n from documents")
def f2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_count("text").alias("n"))


@query("f3_contains_phrase", f"select doc_id, regexp_matches({norm('text')}, '\\bof the\\b') as has_direct, regexp_matches({norm('text')}, '\\bthat\\b') as has_other from documents")
def f3(spark, sf):
    s = table(spark, sf, "documents").withColumn("s", X.normalize("text"))
    return s.select("doc_id", X.contains_phrase("s", "of the").alias("has_direct"), X.contains_phrase("s", "that").alias("has_other"))


@query("f4_mentions", f"with {LABELLED}, {MENTIONED} select doc_id, td_any, td_affirmed, td_negated, td_speculative, ts_any, ts_affirmed, ts_negated, ts_speculative from mentioned")
def f4(spark, sf):
    rows = _cued(spark, sf).select("doc_id", X.mentions("s", LEXICON["toxic"]["direct"]).alias("td"), X.mentions("s", LEXICON["toxic"]["synonym"]).alias("ts"))
    return rows.select("doc_id", *(F.col(f"{a}.{k}").alias(f"{a}_{k}") for a in ("td", "ts") for k in ("any", "affirmed", "negated", "speculative")))


@query("f5_low_information", f"with {LABELLED}, {CONTEXTS} select doc_id, {low('context')} as low from contexts")
def f5(spark, sf):
    return _contexts(spark, sf).select("doc_id", X.low_information("context", LEAST, GENERIC).alias("low"))


EFFECTIVE = "len([w for w in regexp_split_to_array(trim(regexp_replace(coalesce({0}, ''), '_{{2,}}', ' ', 'g')), '\\s+') if regexp_matches(w, '[\\p{{L}}\\p{{N}}]')])::int"
#: Every whole text, with marks put in; texts of marks only and null ones are rows of their own with ids below zero.
MARKED = "marked as (select doc_id, case when doc_id % 2 = 0 then '___-year ' || text else 'a ' || replace(text, ' ', case doc_id % 3 when 0 then ' ___ ' else ' ' end) end as t from documents union all select -1 - doc_id, case doc_id % 4 when 1 then '___ ____ _____' end from documents where doc_id % 4 in (1, 2))"


def _marked(spark, sf):
    docs, id_ = table(spark, sf, "documents"), F.col("doc_id")
    spaced = F.concat(F.lit("a "), F.replace("text", F.lit(" "), F.when(id_ % 3 == 0, " ___ ").otherwise(" ")))
    marked = docs.select("doc_id", F.when(id_ % 2 == 0, F.concat(F.lit("___-year "), "text")).otherwise(spaced).alias("t"))
    return marked.union(docs.where((id_ % 4).isin(1, 2)).select(-1 - id_, F.when(id_ % 4 == 1, "___ ____ _____")))


@query("f6_effective_tokens", f"with {MARKED} select doc_id, {EFFECTIVE.format('t')} as n from marked")
def f6(spark, sf):
    return _marked(spark, sf).select("doc_id", X.effective_tokens("t").alias("n"))


@query("f10_deid_spans", f"with {MARKED} select doc_id, len(regexp_extract_all(coalesce(t, ''), '_{{2,}}'))::int as spans, trim(coalesce(t, '')) <> '' and not regexp_matches(regexp_replace(coalesce(t, ''), '_{{2,}}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]') as only_deid from marked")
def f10(spark, sf):
    return _marked(spark, sf).select("doc_id", X.deid_spans("t").alias("spans"), X.deid_only("t").alias("only_deid"))


@query("f11_mask_digits", "select page_id, trim(regexp_replace(regexp_replace(url, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) as masked from pages")
def f11(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.mask_digits("url").alias("masked"))


@query("f12_one_line", "select doc_id, trim(regexp_replace(regexp_replace(text, '\\n', ' ', 'g'), '\\s+', ' ', 'g')) as line from documents")
def f12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.one_line("text").alias("line"))


@query("f13_study_id", "select o_orderkey, try_cast(nullif(regexp_extract('p/' || case when o_orderkey % 3 = 0 then 'x' else 's' end || o_orderkey || '.txt', '(?:^|[/\\\\])s(\\d+)\\.txt$', 1), '') as bigint) as sid from orders")
def f13(spark, sf):
    name = F.concat(F.lit("p/"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("s"), F.col("o_orderkey"), F.lit(".txt"))
    return table(spark, sf, "orders").select("o_orderkey", X.study_id(name).alias("sid"))


@query("f14_math", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(l_discount - 0.05), 6) as a, round(ln(l_quantity + 1), 6) as b, round(exp(-l_tax), 6) as c, round(sqrt(l_quantity), 6) as d, least(greatest(l_discount, 0.02), 0.08) as e, floor(l_extendedprice)::bigint as f, ceil(l_extendedprice)::bigint as g from lineitem")
def f14(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.abs(d - 0.05), 6).alias("a"), F.round(F.ln(q + 1), 6).alias("b"), F.round(F.exp(-F.col("l_tax")), 6).alias("c"), F.round(F.sqrt(q), 6).alias("d"),
        F.least(F.greatest(d, F.lit(0.02)), F.lit(0.08)).alias("e"), F.floor("l_extendedprice").alias("f"), F.ceil("l_extendedprice").alias("g"),
    )


@query("f15_digest", "select doc_id, sha256(text) as sha, md5(text) as md from documents")
def f15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query("f16_json_list", "select l_orderkey, to_json(list(l_linenumber order by l_linenumber))::varchar as numbers from lineitem group by 1")
def f16(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list("l_linenumber"))).alias("numbers"))


@query("f17_coerce", "select o_orderkey, try_cast(case o_orderkey % 3 when 0 then 'n/a' when 1 then o_orderkey::varchar end as double) as v from orders")
def f17(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "n/a").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", raw.try_cast("double").alias("v"))


@query("f18_image_list", f"with {IMAGES} select study, string_agg(file, ',' order by file) as files from images group by study")
def f18(spark, sf):
    return images(spark, sf).groupBy("study").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


@query("p1_context", "select o_orderkey, concat_ws(' ', nullif(trim(case when o_orderkey % 2 = 0 then o_orderpriority end), ''), nullif(trim(case when o_orderkey % 3 = 0 then '  ' else o_orderstatus end), '')) as context from orders")
def p1(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, F.col("o_orderpriority")).alias("a"), F.when(k % 3 == 0, "  ").otherwise(F.col("o_orderstatus")).alias("b"))
    return rows.select("o_orderkey", X.build_context(["a", "b", "c"], rows.columns).alias("context"))


@query("p2_context_features", f"with {LABELLED}, {CONTEXTS}, {CONTEXT} select doc_id, present, tokens, low, usable, state from context")
def p2(spark, sf):
    return _contexts(spark, sf).select("doc_id", "present", "tokens", "low", "usable", "state")


@query("p3_frontal", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, upper(l_returnflag) in ('A', 'N') as frontal, true as no_view from lineitem")
def p3(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.frontal(rows.columns, "l_returnflag", ["a", "n"]).alias("frontal"), V.frontal(rows.columns, "view", ["a"]).alias("no_view"))


@query("p10_natural_state", f"with {MARKED}, n as (select doc_id, {EFFECTIVE.format('t')} as n from marked) select doc_id, " + ", ".join(f"case when n = 0 then 'N3' when n < {k} then 'N2' else 'N1' end as t{k}" for k in (3, 5, 10)) + " from n")
def p10(spark, sf):
    rows = _marked(spark, sf).withColumn("n", X.effective_tokens("t"))
    return rows.select("doc_id", *(X.natural_state("n", k).alias(f"t{k}") for k in (3, 5, 10)))


_EDGES = "case when n < 5 then 0 when n < 10 then 1 when n < 20 then 2 when n < 40 then 3 when n < 80 then 4 else 5 end"
_SWEEP = "case when n = 0 then null when n <= 5 then '01-05' when n <= 10 then '06-10' when n <= 20 then '11-20' when n <= 40 then '21-40' when n <= 80 then '41-80' else '81+' end"


@query("p11_length_bin", f"with {MARKED}, n as (select doc_id, {EFFECTIVE.format('t')} as n from marked) select doc_id, {_EDGES} as bin from n")
def p11(spark, sf):
    return _marked(spark, sf).select("doc_id", X.length_bin(X.effective_tokens("t")).alias("bin"))


@query("p12_sweep_bin", f"with {MARKED}, n as (select doc_id, {EFFECTIVE.format('t')} as n from marked) select doc_id, {_SWEEP} as bin from n")
def p12(spark, sf):
    return _marked(spark, sf).select("doc_id", X.sweep_bin(X.effective_tokens("t")).alias("bin"))


@query("p13_preflight_bin", f"with {MARKED}, n as (select doc_id, len([w for w in regexp_split_to_array(trim(coalesce(t, '')), '\\s+') if w <> '']) as n from marked) select doc_id, case when n < 1 then '0' when n < 5 then '1-4' when n < 10 then '5-9' else '10+' end as bin from n")
def p13(spark, sf):
    return _marked(spark, sf).select("doc_id", X.preflight_bin("t").alias("bin"))


@query("p4_parse_path", f"with {IMAGES}, bad as (select case when number = 1 then replace(path, '/patient', '/p') else path end as path from images) select path, nullif(regexp_extract(path, '^([^/]+)/(patient[0-9]+)/(study[0-9]+)/([^/]+)$', 2), '') as patient, case when regexp_matches(path, '^([^/]+)/(patient[0-9]+)/(study[0-9]+)/([^/]+)$') then regexp_extract(path, '^([^/]+)/(patient[0-9]+)/(study[0-9]+)/', 2) || '/' || regexp_extract(path, '^([^/]+)/(patient[0-9]+)/(study[0-9]+)/', 3) end as key from bad")
def p4(spark, sf):
    path = F.when(F.col("number") == 1, F.replace("path", F.lit("/patient"), F.lit("/p"))).otherwise(F.col("path"))
    rows = images(spark, sf).select(path.alias("path"))
    return rows.select("path", V.parse_path("path")["patient"].alias("patient"), V.study_key("path").alias("key"))


@query("p5_view_number", f"with {IMAGES} select path, try_cast(nullif(regexp_extract(upper(file), '(?i)view([0-9]+)', 1), '') as int) as number from images")
def p5(spark, sf):
    return images(spark, sf).select("path", V.view_number(F.upper("file")).alias("number"))


RAW = "raws as (select o_orderkey as study, case o_orderkey % 7 when 0 then '1' when 1 then '0' when 2 then '-1.0' when 3 then null when 4 then '2' when 5 then 'x' else '1.0' end as v from orders)"


def _raws(spark, sf):
    h = F.col("o_orderkey") % 7
    v = F.when(h == 0, "1").when(h == 1, "0").when(h == 2, "-1.0").when(h == 3, F.lit(None)).when(h == 4, "2").when(h == 5, "x").otherwise("1.0")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("study"), v.alias("v"))


_ENCODED = "case when try_cast(v as double) in (1, 0, -1) then try_cast(v as double) end"


@query("p6_encode_state", f"with {RAW} select study, {_ENCODED} as state from raws")
def p6(spark, sf):
    return _raws(spark, sf).select("study", V.encode_state("v").alias("state"))


@query("p7_state_masks", f"with {RAW}, n as (select study, try_cast(v as double) as d from raws) select study, d is not null as known, coalesce(d = 1, false) as pos, coalesce(d = 0, false) as neg, coalesce(d = -1, false) as unc, d is null as unmentioned from n")
def p7(spark, sf):
    return _raws(spark, sf).select("study", V.state_masks("v").alias("s")).select("study", "s.*")


@query("p8_label_category", f"with {RAW}, n as (select study, try_cast(v as double) as d from raws) select study, case when d = 1 then 'pos' when d = 0 then 'neg' when d = -1 then 'unc' else 'unm' end as category from n")
def p8(spark, sf):
    return _raws(spark, sf).select("study", V.label_category("v").alias("category"))


@query("p9_label_variant", f"with {RAW}, n as (select study, {_ENCODED} as d from raws), m as (select study, case when d >= 0 then d end as a, case when d is null then 0.0 when d >= 0 then d end as b, case when d = -1 then 1.0 else d end as c, case when d = -1 then 0.0 else d end as e from n) select study, coalesce(a, 0.0) as primary_label, a is not null as primary_mask, coalesce(b, 0.0) as unmentioned_label, b is not null as unmentioned_mask, coalesce(c, 0.0) as positive_label, c is not null as positive_mask, coalesce(e, 0.0) as negative_label, e is not null as negative_mask from m")
def p9(spark, sf):
    out = []
    for variant, name in zip(V.VARIANTS, ("primary", "unmentioned", "positive", "negative")):
        got = V.label_variant("v", variant)
        out += [got["label"].alias(f"{name}_label"), got["mask"].alias(f"{name}_mask")]
    return _raws(spark, sf).select("study", *out)


@query("p14_age_band", "with a as (select c_custkey, case when c_custkey % 11 = 0 then 'old' else (c_custkey % 120 - 2)::varchar end as age from customer), n as (select c_custkey, try_cast(age as double) as a from a) select c_custkey, case when a > -1 and a <= 39 then '0-39' when a > 39 and a <= 64 then '40-64' when a > 64 and a <= 79 then '65-79' when a > 79 and a <= 200 then '80+' else 'Unknown' end as band from n")
def p14(spark, sf):
    k = F.col("c_custkey")
    age = F.when(k % 11 == 0, "old").otherwise((k % 120 - 2).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", V.age_band(age).alias("band"))


@query("p15_view_stratum", "select l_orderkey, string_agg(distinct l_returnflag, '|' order by l_returnflag) as views from lineitem group by 1")
def p15(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(V.view_stratum("l_returnflag").alias("views"))


@query("p20_safe_columns", "select c_custkey, c_acctbal from customer")
def p20(spark, sf):
    return A.safe_columns(table(spark, sf, "customer").withColumn("_internal_key", F.lit(1)), ["c_name", "c_nationkey", "c_mktsegment"])


@query("p22_paths", f"with {IMAGES} select path, array_to_string(string_split(path || '/x.dcm', '/')[1:4], '/') || '.txt' as report, regexp_replace(path || '/x.dcm', '\\.dcm$', '.jpg') as jpeg from images")
def p22(spark, sf):
    full = F.concat("path", F.lit("/x.dcm"))
    return images(spark, sf).select("path", V.report_path(full).alias("report"), V.jpeg_path(full).alias("jpeg"))


@query("p23_class_state", "select o_orderkey, case o_orderkey % 4 when 1 then 1.0 when 2 then 0.0 when 3 then -1.0 end::double as state from orders")
def p23(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", V.class_state(F.col("o_orderkey") % 4).alias("state"))


@query("a1_section_availability", f"with {LABELLED}, {CONTEXTS}, {CONTEXT} select state, count(*) as n, round(count(*) / (sum(count(*)) over ())::double, 6) as fraction from context group by state")
def a1(spark, sf):
    return A.distribution(_contexts(spark, sf), "state")


_PREVALENCE = "count(v) as n_known, count(*) filter (v = 1) as n_pos, count(*) filter (v = 0) as n_neg, count(*) filter (v = -1) as n_unc, count(*) filter (v is null) as n_missing, round(count(*) filter (v = 1) / greatest(1, count(v))::double, 6) as prevalence"


@query("a2_label_prevalence", f"with {LABELLED_LONG}, w as (select *, 1.0::double / count(*) over (partition by cluster) as weight from labelled), l as (select 'quality' as label, quality as v, weight from w union all select 'toxic', toxic, weight from w) select label, {_PREVALENCE}, round(sum(case when v = 1 then weight else 0 end) / nullif(sum(case when v is not null then weight else 0 end), 0), 6) as weighted_prevalence from l group by label")
def a2(spark, sf):
    rows = A.study_weights(labelled(spark, sf), "cluster").select("weight", "quality", "toxic")
    return A.label_prevalence(A.unpivot(rows, ["quality", "toxic"]), "weight")


@query("a3_leakage", f"""with {LABELLED}, {MENTIONED}, s as (
  select *, 'all' as subset from mention_long union all
  select *, case v when 1 then 'pos' when 0 then 'neg' else 'unc' end from mention_long where v is not null)
select label, subset, count(*) as n, round(avg(d_any::int), 6) as direct, round(avg((d_any or s_any)::int), 6) as any, round(avg(affirmed::int), 6) as affirmed, round(avg(negated::int), 6) as negated, round(avg(speculative::int), 6) as speculative from s group by 1, 2""")
def a3(spark, sf):
    return A.leakage(_mention_long(spark, sf))


@query("a4_leakage_table", f"with {LABELLED}, {MENTIONED} select label, round(avg(d_any::int), 6) as direct_rate, round(avg((s_any and not d_any)::int), 6) as synonym_rate, round(avg(d_any::int) filter (v = 1), 6) as direct_rate_pos, round(avg((s_any and not d_any)::int) filter (v = 1), 6) as synonym_rate_pos from mention_long group by label")
def a4(spark, sf):
    return A.leakage_table(_mention_long(spark, sf))


_MISSING = "count(*) as n, round(avg((state = 'absent')::int), 6) as absent, round(avg((state = 'low_information')::int), 6) as low"


@query("a5_missingness_by_label", f"with {LABELLED}, {CONTEXTS}, {CONTEXT}, {CONTEXT_LONG} select label, label_state, {_MISSING} from context_long where label_state <> 'unm' group by 1, 2")
def a5(spark, sf):
    return A.missingness_by_label(_context_long(spark, sf))


@query("a6_missingness_relationship", f"with {LABELLED}, {CONTEXTS}, {CONTEXT}, {CONTEXT_LONG}, m as (select label, label_state, {_MISSING} from context_long group by 1, 2) select label, count(*) as states, round(max(absent) - min(absent), 6) as spread, round(max(absent) - min(absent), 6) >= 0.05 as related from m group by label")
def a6(spark, sf):
    return A.missingness_relationship(_context_long(spark, sf))


@query("a7_split_overlap", f"with {STUDIES}, k as (select distinct patient, split from studies) select x.split as a, y.split as b, count(*) as n from k x join k y on x.patient = y.patient and x.split <= y.split group by 1, 2")
def a7(spark, sf):
    return A.split_overlap(studies(spark, sf))


@query("a8_gate", f"""with {LABELLED}, {MENTIONED}, {CONTEXTS}, {CONTEXT}, c as (select avg(usable::int) as usable, avg((state <> 'usable')::int) as missing from context),
l as (select label, count(*) filter (v = 1) as pos, coalesce(avg(d_any::int) filter (v = 1), 1.0) as direct from mention_long group by label),
g as (select count(*) filter (pos >= 20) as viable, max(direct) as leak from l)
select round(usable, 6) as usable, round(missing, 6) as missing, viable, round(leak, 6) as leak, case when usable >= 0.5 and missing <= 0.5 and viable >= 1 and leak <= 0.8 then 'PASS' else 'FAIL' end as verdict from c, g""")
def a8(spark, sf):
    return A.gate(_contexts(spark, sf), _mention_long(spark, sf))


@query("a9_summary", f"with {IMAGES}, {LABELLED}, {CONTEXTS}, {CONTEXT}, i as (select count(distinct study) as studies, count(distinct case when view = 'Frontal' then study end) as frontal_studies from images), t as (select median(tokens) as median_tokens from context) select studies, frontal_studies, median_tokens from i, t")
def a9(spark, sf):
    i = images(spark, sf).agg(F.count_distinct("study").alias("studies"), F.count_distinct(F.when(F.col("view") == "Frontal", F.col("study"))).alias("frontal_studies"))
    return i.join(F.broadcast(quantiles(_contexts(spark, sf), [], "tokens", [0.5]).select(F.col("q")[0].alias("median_tokens"))))


@query("a10_site_comparison", f"""with {LABELLED}, {CONTEXTS}, {CONTEXT}, s as (
  select avg(usable::int) filter (site = 'en') as source_usable, avg((state = 'absent')::int) filter (site = 'en') as source_absent, median(tokens) filter (site = 'en') as source_tokens,
    avg(usable::int) filter (site = 'fr') as target_usable, avg((state = 'absent')::int) filter (site = 'fr') as target_absent, median(tokens) filter (site = 'fr') as target_tokens from context)
select round(source_usable, 6) as source_usable, round(source_absent, 6) as source_absent, round(source_tokens, 6) as source_tokens, round(target_usable, 6) as target_usable, round(target_absent, 6) as target_absent, round(target_tokens, 6) as target_tokens,
  round(target_usable - source_usable, 6) as d_usable, round(target_absent - source_absent, 6) as d_absent, round(target_tokens - source_tokens, 6) as d_tokens,
  abs(target_usable - source_usable) >= 0.05 or abs(target_absent - source_absent) >= 0.05 or abs(target_tokens - source_tokens) >= 3 as shift from s""")
def a10(spark, sf):
    return A.compare_sites(_contexts(spark, sf), "en", "fr")


@query("a11_cohort_structure", f"with {IMAGES}, s as (select 'all' as scope, * from images union all select 'frontal', * from images where view = 'Frontal'), p as (select scope, study, any_value(patient) as patient, count(*) as n from s group by 1, 2) select scope, sum(n)::bigint as images, count(distinct patient) as patients, count(*) as studies, min(n) as least, median(n) as median, round(avg(n), 6) as mean, max(n) as most from p group by scope")
def a11(spark, sf):
    return A.structure(images(spark, sf), F.col("view") == "Frontal")


@query("a12_context_availability", f"""with {LABELLED}, two as (select doc_id, 1.0::double / count(*) over (partition by cluster) as weight, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then ' ' else text end as history, case when doc_id % 5 = 0 then '' else text end as indication from labelled),
contexts as (select weight, 'history' as field, history as context from two union all select weight, 'indication', indication from two), {CONTEXT}
select field, round(avg((context is null)::int), 6) as null_rate, round(avg((not present)::int), 6) as empty_rate, round(avg(usable::int), 6) as usable_rate, round(avg(low::int), 6) as low_rate, round(sum(case when present then weight else 0 end) / sum(weight), 6) as weighted_present,
  round(sum(case when usable then weight else 0 end) / sum(weight), 6) as weighted_usable, median(tokens) filter (present) as median_tokens, count(*) filter (tokens < 3) as below_3, count(*) filter (tokens < 5) as below_5, count(*) filter (tokens < 10) as below_10 from context group by field""")
def a12(spark, sf):
    h = F.col("doc_id") % 3
    rows = A.study_weights(labelled(spark, sf), "cluster")
    rows = rows.withColumn("history", F.when(h == 1, " ").when(h == 2, F.col("text"))).withColumn("indication", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")))
    return A.field_availability(rows, ["history", "indication"], LEAST, GENERIC, "weight")


@query("a13_weighted_median", f"with {IMAGES}, w as (select site, quantity, sum(1.0::double / n) as w from (select *, count(*) over (partition by study) as n from images) group by 1, 2), r as (select *, sum(w) over (partition by site order by quantity) as c, sum(w) over (partition by site) as t from w) select site, min(quantity) as median from r where c >= t / 2 - 1e-12 group by site")
def a13(spark, sf):
    return A.weighted_median(A.study_weights(images(spark, sf)), ["site"], "quantity", "weight")


@query("a14_label_distribution", f"""with {LABELLED}, w as (select *, 1.0::double / count(*) over (partition by cluster) as weight from labelled), l as (select 'quality' as label, quality as v, weight, site, cluster from w union all select 'toxic', toxic, weight, site, cluster from w),
s as (select label, v, weight, 'site' as stratum, site as value from l union all select label, v, weight, 'cluster', cluster from l)
select label, stratum, value, count(*) as n, round(count(*) filter (v = 1) / nullif(count(*) filter (v >= 0), 0)::double, 6) as positive, round(sum(case when v = 1 then weight else 0 end) / nullif(sum(case when v >= 0 then weight else 0 end), 0), 6) as weighted_positive from s group by 1, 2, 3""")
def a14(spark, sf):
    rows = A.study_weights(labelled(spark, sf), "cluster").select("weight", "site", "cluster", "quality", "toxic")
    return A.label_distribution(A.unpivot(rows, ["quality", "toxic"]), ["site", "cluster"], "weight")


_IMAGE_STATE = "case {0} % 5 when 0 then null when 1 then -1.0 when 2 then 0.0 else 1.0 end::double"
_SQL_STATE = _IMAGE_STATE.format(sql_hash("'v:' || study || ':' || number % 3"))
IMAGE_LABELS = IMAGES + f""", image_labels as (select 'finding' as label, study, number, file, {_SQL_STATE} as v from images)"""
_CATEGORY = "case when v = 1 then 'pos' when v = 0 then 'neg' when v = -1 then 'unc' else 'unm' end"


def _image_labels(spark, sf):
    h = V.portable_hash(F.lit("v"), "study", F.col("number") % 3) % 5
    v = F.when(h == 0, F.lit(None)).when(h == 1, -1.0).when(h == 2, 0.0).otherwise(1.0)
    return images(spark, sf).select(F.lit("finding").alias("label"), "study", "number", "file", v.alias("v"))


@query("a15_disagreement", f"with {IMAGE_LABELS}, s as (select distinct label, study, {_CATEGORY} as c, count(*) over (partition by label, study) as n, from image_labels), k as (select label, study, c, n, count(*) over (partition by label, study) as k from s) select x.label, x.c as a, y.c as b, count(*) as studies from k x join k y on x.label = y.label and x.study = y.study and x.c <= y.c where x.n > 1 and (x.c < y.c or x.k = 1) group by 1, 2, 3")
def a15(spark, sf):
    return A.disagreement(_image_labels(spark, sf))


@query("a15_disagreement_summary", f"with {IMAGE_LABELS}, s as (select label, study, count(distinct {_CATEGORY}) as k, count(*) as n from image_labels group by 1, 2 having count(*) > 1) select label, count(*) filter (k = 1) as identical, count(*) filter (k > 1) as differing from s group by label")
def a15b(spark, sf):
    return A.disagreement_summary(_image_labels(spark, sf))


@query("a16_concordant", f"with {IMAGE_LABELS} select study, file, v, coalesce(min(v) over w = max(v) over w, true) as concordant from image_labels window w as (partition by label, study)")
def a16(spark, sf):
    return A.concordant(_image_labels(spark, sf)).select("study", "file", "v", "concordant")


@query("a17_image_policies", f"""with {IMAGE_LABELS}, r as (select *, 1.0::double / count(*) over w as weight, row_number() over (partition by label, study order by number, file) = 1 as first, coalesce(min(v) over w = max(v) over w, true) as conc from image_labels window w as (partition by label, study)),
s as (select label, sum((v = 1)::int) / sum((v >= 0)::int)::double as a, sum(case when v = 1 then weight else 0 end) / sum(case when v >= 0 then weight else 0 end) as b, sum((v = 1 and first)::int) / sum((v >= 0 and first)::int)::double as c, sum((v = 1 and conc)::int) / sum((v >= 0 and conc)::int)::double as d from r group by label)
select label, round(a, 6) as all_images, round(b, 6) as study_equal, round(c, 6) as one_image, round(d, 6) as concordant, round(greatest(a, b, c, d) - least(a, b, c, d), 6) as spread from s""")
def a17(spark, sf):
    return A.image_policies(_image_labels(spark, sf))


@query("w1_study_weights", f"with {IMAGES} select study, file, round(1.0::double / count(*) over (partition by study), 6) as weight from images")
def w1(spark, sf):
    return A.study_weights(images(spark, sf)).select("study", "file", F.round("weight", 6).alias("weight"))


@query("w2_first_view", f"with {IMAGES} select study, file from (select *, row_number() over (partition by study order by number, file) as n from images) where n = 1")
def w2(spark, sf):
    return A.first_view(images(spark, sf)).select("study", "file")


@query("w3_frontal_preferred", f"with {IMAGES} select study, view, file from (select *, row_number() over (partition by study order by view = 'Frontal' desc, file) as n from images) where n = 1")
def w3(spark, sf):
    return A.prefer(images(spark, sf), "study", (F.col("view") == "Frontal").desc(), F.col("file")).select("study", "view", "file")


@query("w4_drop_duplicates", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id) as n from events) where n = 1")
def w4(spark, sf):
    return A.prefer(table(spark, sf, "events"), "user_id", F.desc("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


_PATTERNS = {"digits": "[0-9]{3,}", "upper": "[A-Z]{4,}", "mail": "[a-z0-9.]+@[a-z0-9.]+", "table": r"\|", "licence": "(?i)licen[cs]e"}


@query("a43_pattern_scan", "select count(*) as n, " + ", ".join(f"round(avg(regexp_matches(text, '{p}')::int), 6) as {k}" for k, p in _PATTERNS.items()) + " from documents")
def a43(spark, sf):
    return A.pattern_scan(table(spark, sf, "documents"), "text", _PATTERNS)


@query("a44_endpoint_prevalence", f"with {LABELLED_LONG} select label, count(*) as studies, round(count(*) filter (v = 1) / count(*)::double, 6) as pos, round(count(*) filter (v = 0) / count(*)::double, 6) as neg, round(count(*) filter (v = -1) / count(*)::double, 6) as unc, round(count(*) filter (v is null) / count(*)::double, 6) as unm from long group by label")
def a44(spark, sf):
    share = lambda c: F.round(F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)), 6)
    v = F.col("v")
    return _long(spark, sf).groupBy("label").agg(F.count("*").alias("studies"), share(v == 1).alias("pos"), share(v == 0).alias("neg"), share(v == -1).alias("unc"), share(v.isNull()).alias("unm"))
