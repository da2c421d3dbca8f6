"""Queries over reports with sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortaudit.functions import text as X
from cohortaudit.operators import sections as S
from cohortaudit.plans.audit_queries import _EDGES, EFFECTIVE
from cohortaudit.plans.inputs import REPORTS, reports, table
from cohortaudit.plans.book import query

_HEAD = "(?m)^[ \\t]*([A-Z][A-Z0-9 /&''()\\.\\,\\-\\*]{0,60}?)[ \\t]*:"
_MAP = "section_map(header, section, class) as (values " + ", ".join(f"('{h}', '{s}', '{c}')" for c, named in S.SECTIONS.items() for s, hs in named.items() for h in hs) + ")"
PARSED = f"""{REPORTS}, {_MAP},
pieces as (select doc_id, patient, lang, regexp_extract_all(report, '{_HEAD}', 1) as hs, regexp_split_to_array(report, '{_HEAD}') as bs from reports),
rows0 as (select doc_id, patient, lang, unnest(range(0, len(hs))) as pos, hs, bs from pieces),
parsed as (select doc_id, patient, lang, pos, trim(regexp_replace(hs[pos + 1], '\\s+', ' ', 'g')) as header, regexp_replace(bs[pos + 2], '^\\s+|\\s+$', '', 'g') as body from rows0),
mapped as (select p.*, m.section, m.class from parsed p left join section_map m on p.header = m.header)"""


def _parsed(spark, sf):
    return S.parse_sections(reports(spark, sf), "report", ["doc_id", "patient", "lang"], S.section_map(spark))


@query("f7_parse_plain", f"""with {REPORTS}, pieces as (select doc_id, regexp_extract_all(report, '(?m)^\\s*([A-Z][A-Z /_-]{{2,40}})\\s*:\\s*', 1) as hs, regexp_split_to_array(report, '(?m)^\\s*([A-Z][A-Z /_-]{{2,40}})\\s*:\\s*') as bs from reports),
r as (select doc_id, unnest(range(0, len(hs))) as pos, hs, bs from pieces),
n as (select doc_id, pos, lower(trim(hs[pos + 1])) as h, regexp_replace(bs[pos + 2], '^\\s+|\\s+$', '', 'g') as body from r),
c as (select doc_id, pos, case when h in ('history', 'indication') then 'history' else h end as section, body from n union all
  select doc_id, -1, case when len(hs) = 0 then 'unsectioned' else 'prefix' end, regexp_replace(bs[1], '^\\s+|\\s+$', '', 'g') from pieces where len(hs) = 0 or regexp_replace(bs[1], '^\\s+|\\s+$', '', 'g') <> '')
select doc_id, section, regexp_replace(string_agg(body, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as body from c group by 1, 2""")
def f7(spark, sf):
    return S.parse_plain(reports(spark, sf), "report", ["doc_id"])


@query("f8_parse_sections", f"with {PARSED} select doc_id, pos::int as pos, header, section, class, body from mapped")
def f8(spark, sf):
    return _parsed(spark, sf).drop("patient", "lang")


@query("f8_section_text", f"with {PARSED} select doc_id, string_agg(body, ' ' order by pos) as context from mapped where section in ('indication', 'history') and body <> '' group by 1")
def f8b(spark, sf):
    return S.section_text(_parsed(spark, sf), "doc_id", ["indication", "history"])


@query("f9_banner", f"with {REPORTS} select doc_id, nullif(regexp_extract(report, '(?m)^\\s*(FINAL REPORT|FINAL ADDENDUM|PRELIMINARY REPORT)\\s*$', 1), '') as banner from reports")
def f9(spark, sf):
    return reports(spark, sf).select("doc_id", S.banner("report").alias("banner"))


_EFF = EFFECTIVE.format("body")


@query("a24_section_statistics", f"""with {PARSED}, p as (select section, doc_id, count(*) as n, count(*) filter (body = '') as empty, sum(len(regexp_extract_all(body, '_{{2,}}'))) as spans, count(*) filter (trim(body) <> '' and not regexp_matches(regexp_replace(body, '_{{2,}}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]')) as only_deid, sum({_EFF}) as tokens from mapped where section is not null group by 1, 2)
select section, count(*) as reports, sum(n)::bigint as occurrences, count(*) filter (n > 1) as repeats, sum(empty)::bigint as empty_bodies, sum(spans)::bigint as deid_spans, sum(only_deid)::bigint as deid_only, sum(tokens)::bigint as tokens, max(tokens)::bigint as most_tokens from p group by section""")
def a24(spark, sf):
    return S.section_statistics(_parsed(spark, sf), "doc_id")


@query("a25_availability", f"""with {PARSED}, f as (select doc_id, max((class = 'pre_diagnostic' and body <> '')::int) as pre, max((section = 'impression')::int) as impression, max((section = 'findings')::int) as findings from mapped group by 1)
select coalesce(pre, 0) as pre, coalesce(impression, 0) as impression, coalesce(findings, 0) as findings, count(*) as reports from reports left join f using (doc_id) group by 1, 2, 3""")
def a25(spark, sf):
    return S.availability(_parsed(spark, sf), reports(spark, sf), "doc_id")


@query("a26_section_pairs", f"with {PARSED}, s as (select distinct doc_id, section from mapped where section is not null) select x.section as a, y.section as b, count(*) as reports from s x join s y on x.doc_id = y.doc_id and x.section < y.section group by 1, 2 order by reports desc, a, b limit 25")
def a26(spark, sf):
    return S.section_pairs(_parsed(spark, sf), "doc_id")


@query("a27_order_violations", f"with {PARSED} select doc_id, coalesce(max(case when class = 'pre_diagnostic' then pos end) > min(case when class = 'label_source' then pos end), false) as violates from mapped group by 1")
def a27(spark, sf):
    return S.order_violations(_parsed(spark, sf), "doc_id")


@query("a28_unknown_headers", f"with {PARSED} select trim(regexp_replace(regexp_replace(header, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) as header, count(*) as n from mapped where section is null group by 1 having count(*) >= 5")
def a28(spark, sf):
    return S.unknown_headers(_parsed(spark, sf), 5)


@query("a29_index_summary", f"""with {PARSED}, v as (select section, {_EFF} as tokens from mapped where section is not null), r as (select *, row_number() over (partition by section order by tokens) - 1 as i, count(*) over (partition by section) as n from v)
select section, max(n) as n, round(avg(tokens), 6) as mean, floor(median(tokens))::bigint as median, max(case when i = floor(0.95 * (n - 1)) then tokens end) as p95, min(tokens) as least, max(tokens) as most from r group by section""")
def a29(spark, sf):
    return S.index_summary(_parsed(spark, sf).where("section is not null").withColumn("tokens", X.effective_tokens("body")), ["section"], "tokens")


_SETS = {"indication": ["indication"], "both": ["indication", "history"]}
_GRID = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30]


@query("a30_threshold_sweep", f"""with {PARSED}, t as (select s.name as set, r.doc_id, max(coalesce((m.section = 'impression')::int, 0)) as labelled, coalesce(sum({_EFF}) filter (m.section = 'indication' or (s.name = 'both' and m.section = 'history')), 0)::bigint as tokens
  from reports r cross join (values ('indication'), ('both')) s(name) left join mapped m on r.doc_id = m.doc_id group by 1, 2), g as (select unnest({_GRID}) as threshold)
select set, labelled, threshold, count(*) filter (tokens >= threshold) as n1, count(*) filter (tokens > 0 and tokens < threshold) as n2, count(*) filter (tokens = 0) as n3 from t, g group by 1, 2, 3""")
def a30(spark, sf):
    parsed = _parsed(spark, sf)
    every = reports(spark, sf).select("doc_id")
    out = None
    for name, sections in _SETS.items():
        per = parsed.groupBy("doc_id").agg(F.max(F.when(F.col("section") == "impression", 1).otherwise(0)).alias("labelled"), F.sum(F.when(F.col("section").isin(sections), X.effective_tokens("body")).otherwise(0)).alias("tokens"))
        part = every.join(per, "doc_id", "left").select(F.lit(name).alias("set"), F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return S.threshold_sweep(out, _GRID)


@query("a31_swap_feasibility", f"with n as (select source as patient, {EFFECTIVE.format('text')} as n from documents), b as (select patient, {_EDGES} as bin from n), p as (select bin, patient, count(*) as n from b group by 1, 2) select bin, sum(n)::bigint as rows, count(*) as patients, max(n) as largest, count(*) >= 2 and max(n) <= sum(n) - max(n) as feasible from p group by bin")
def a31(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("patient"), X.length_bin(X.effective_tokens("text")).alias("bin"))
    return S.swap_feasibility(rows, "bin", "patient")


@query("w11_top_pairs", f"with {PARSED}, s as (select distinct doc_id, section from mapped where section is not null) select x.section as a, y.section as b, count(*) as reports from s x join s y on x.doc_id = y.doc_id and x.section < y.section group by 1, 2 order by reports desc, a, b limit 3")
def w11(spark, sf):
    return S.section_pairs(_parsed(spark, sf), "doc_id", 3)
