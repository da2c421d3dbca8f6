"""Queries of resampled families: levels, policies, subgroups, label sources, swaps and refits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortaudit.functions import values as V
from cohortaudit.operators import calibration as L
from cohortaudit.operators import families as G
from cohortaudit.operators import interventions as I
from cohortaudit.operators import policy as K
from cohortaudit.operators import resample as B
from cohortaudit.operators import risk as R
from cohortaudit.operators.audit import count_if
from cohortaudit.plans.draws_sql import counts_cte
from cohortaudit.plans.inputs import PREDICTIONS, predictions, sql_hash, sql_unit, studies, table
from cohortaudit.plans.book import query
from cohortaudit.plans.risk_queries import _ALPHAS, _COLD, _FX, _LOGIT, _PLATT, C0, CELLS, CONDITIONS, CURVE, CURVE_REPS, PASSES, REPS, SWAP, TERMS, T, _auc, _c0, _cal, _cells, _ctx, _est, _passes, _patients, _policy, _terms
from cohortaudit.sources.scratch import kept

SITES = ("external", "source")
EVALUATION = "(select site, patient from studies where split = 'evaluation')"
#: The terms of a study's cells (decision, y), in DuckDB.
TERM_SQL = "1.0::double as one, (count(y) > 0)::int::double as evaluable, (count(*) filter (decision::int <> y))::double / greatest(count(y), 1) as e_orig, (count(*) filter (decision::int <> y))::double as n_wrong, count(y)::double as n_obs, " + ", ".join(f"(count(*) filter (target = '{t}' and decision::int <> y))::double as wrong_{t}, (count(*) filter (target = '{t}' and y is not null))::double as obs_{t}" for t in T)


def _sql_measures(names: tuple[str, ...]) -> str:
    found = {"coverage_all": "(case when all_one > 0 then a_one / all_one end)", "coverage_evaluable": "(case when all_evaluable > 0 then a_evaluable / all_evaluable end)"} | _est("a_")
    return f"unnest([{', '.join(repr(n) for n in names)}]) as measure, unnest([{', '.join(f'round({found[n]}, 12)' for n in names)}]) as value"


def _boot(terms: str, keys: str, names: tuple[str, ...] = G.MEASURES, reps: int = REPS, seed: str = "b", patients: str = EVALUATION, pre: str = "f") -> str:
    """CTEs <pre>points(site, keys, measure, value) and <pre>draws(rep, ...) of a table of terms with accepted."""
    sums = ", ".join(f"sum(case when accepted then {c} else 0 end) as a_{c}, sum({c}) as all_{c}" for c in TERMS)
    again = lambda w: ", ".join(f"sum({w}a_{c}) as a_{c}, sum({w}all_{c}) as all_{c}" for c in TERMS)
    return f"""{pre}p as (select site, patient, row_number() over (partition by site order by patient) - 1 as i, count(*) over (partition by site) as n from (select distinct site, patient from {patients})),
{counts_cte(reps, seed, f"{pre}p", f"{pre}counts")},
{pre}s as materialized (select site, patient, {keys}, {sums} from {terms} group by all),
{pre}points as materialized (select site, {keys}, {_sql_measures(names)} from (select site, {keys}, {again("")} from {pre}s group by all)),
{pre}draws as materialized (select rep, site, {keys}, {_sql_measures(names)} from (select rep, site, {keys}, {again("n * ")} from {pre}s join {pre}counts using (site, patient) group by all))"""


def _difference(rows: str, keys: str, axis: str, plus: str, minus: str) -> str:
    return f"(select {keys}, measure, max(value) filter ({axis} = '{plus}') - max(value) filter ({axis} = '{minus}') as value from {rows} where {axis} in ('{plus}', '{minus}') group by all)"


def _estimates(points: str, draws: str, keys: str) -> str:
    ci = f"select {keys}, measure, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.975), 6) as high from {draws} group by all"
    return f"select {keys}, measure, round(value, 6) as value, low, high from {points} left join ({ci}) using ({keys}, measure)"


def _gap(keys: str, pre: str = "f") -> str:
    """Levels at both sites and their difference with its interval."""
    at = lambda s: f"round(max(value) filter (site = '{s}'), 6) as {s}"
    gap = _estimates(_difference(f"{pre}points", keys, "site", *SITES), _difference(f"{pre}draws", f"rep, {keys}", "site", *SITES), keys)
    return f"select {keys}, measure, source, external, value as gap, low, high from ({gap}) join (select {keys}, measure, {at('source')}, {at('external')} from {pre}points group by all) using ({keys}, measure)"


def _gaps(points, draws, keys):
    """As _gap, in Spark."""
    at = lambda s: F.round(F.max(F.when(F.col("site") == s, F.col("value"))), 6).alias(s)
    levels = points.groupBy(*keys, "measure").agg(at("source"), at("external"))
    gap = G.estimates(G.difference(points, "site", *SITES), G.difference(draws, "site", *SITES)).withColumnRenamed("value", "gap")
    return levels.join(gap, [*keys, "measure"])


# levels and coverage -----------------------------------------------------------------
_LEVEL_KEYS = "site, model, condition"


@query("b6_levels", f"with {CELLS}, {_boot('terms', 'model, condition')} {_estimates('fpoints', 'fdraws', _LEVEL_KEYS)}")
def b6_levels(spark, sf):
    return G.estimates(*G.items(_terms(spark, sf), _patients(spark, sf), ["model", "condition"], T, REPS, "b"))


@query("b6_coverage_gaps", f"with {CELLS}, {_boot('terms', 'model, condition', ('coverage_all',))} {_gap('model, condition')}")
def b6_coverage_gaps(spark, sf):
    return _gaps(*G.items(_terms(spark, sf), _patients(spark, sf), ["model", "condition"], T, REPS, "b", ("coverage_all",)), ["model", "condition"])


# subgroups ---------------------------------------------------------------------------
_TWO = ("coverage_all", "evaluable_study")
#: Strata overlap: all studies, their segment, and the half that the patient's number says.
_STRATA = "st as (select *, unnest(['all', segment, case when patient % 2 = 0 then 'even' else 'odd' end]) as stratum from terms where condition = 'C0')"
_VARIABLES = "va as (select *, unnest(['segment', 'half']) as variable, unnest([segment, case when patient % 2 = 0 then 'even' else 'odd' end]) as grp from terms where condition = 'C0' and site = 'external'), big as (select variable, grp from va where model = 'm1' group by 1, 2 having count(*) >= 10), vb as (select * from va semi join big using (variable, grp))"


@query("r17_subgroup_gaps", f"with {CELLS}, {_STRATA}, {_boot('st', 'stratum, model', _TWO)}, ns as (select stratum, model, count(*) filter (site = 'source') as studies_source, count(*) filter (site = 'external') as studies_external from st group by 1, 2) select * from ({_gap('stratum, model')}) join ns using (stratum, model)")
def r17_gaps(spark, sf):
    half = F.when(F.col("patient") % 2 == 0, "even").otherwise("odd")
    terms = _terms(spark, sf).where("condition = 'C0'").withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("segment"), half)))
    at = lambda s: count_if(F.col("site") == s).alias(f"studies_{s}")
    sizes = terms.groupBy("stratum", "model").agg(at("source"), at("external"))
    return _gaps(*G.items(terms, _patients(spark, sf), ["stratum", "model"], T, REPS, "b", _TWO), ["stratum", "model"]).join(sizes, ["stratum", "model"])


def _grouped(spark, sf):
    """External studies once for each variable, in groups of at least 10 studies."""
    half = F.when(F.col("patient") % 2 == 0, "even").otherwise("odd")
    pair = F.explode(F.array(F.struct(F.lit("segment").alias("variable"), F.col("segment").alias("grp")), F.struct(F.lit("half").alias("variable"), half.alias("grp"))))
    rows = _terms(spark, sf).where("condition = 'C0' and site = 'external'").withColumn("v", pair).select("*", "v.*").drop("v")
    big = rows.where("model = 'm1'").groupBy("variable", "grp").count().where("count >= 10").select("variable", "grp")
    return G.items(rows.join(F.broadcast(big), ["variable", "grp"], "left_semi"), _patients(spark, sf), ["variable", "grp", "model"], T, REPS, "b", _TWO)


_VB = f"{CELLS}, {_VARIABLES}, {_boot('vb', 'variable, grp, model', _TWO)}"


@query("r18_groups", f"with {_VB} {_estimates('fpoints', 'fdraws', 'site, variable, grp, model')}")
def r18_groups(spark, sf):
    return G.estimates(*_grouped(spark, sf))


def _extremes(rows: str, keys: str) -> str:
    return f"(select {keys}, 'disparity' as measure, max(value) - min(value) as value from {rows} where measure = 'coverage_all' group by all union all select {keys}, 'worst_evaluable_study', max(value) from {rows} where measure = 'evaluable_study' group by all)"


_VK = "site, variable, model"


@query("r18_disparity_intervals", f"with {_VB}, e as ({_estimates(_extremes('fpoints', _VK), _extremes('fdraws', 'rep, ' + _VK), _VK)}) select e.*, w.grp as worst from e left join (select {_VK}, 'worst_evaluable_study' as measure, arg_min(grp, {{'v': -value, 'g': grp}}) as grp from fpoints where measure = 'evaluable_study' and value is not null group by all) w using ({_VK}, measure)")
def r18_intervals(spark, sf):
    points, draws = _grouped(spark, sf)
    got = G.estimates(G.extremes(points, "grp"), G.extremes(draws, "grp"))
    return got.join(G.worst_group(points, "grp").withColumnRenamed("grp", "worst"), ["site", "variable", "model", "measure"], "left")


# policies at both sites --------------------------------------------------------------
_FITS = f"""{_FX}, {_PLATT}, {_COLD},
sx as (select model, target, case when y = 1 then 1 - p else p end as s from cal where y is not null), rx as (select *, row_number() over (partition by model, target order by s) as r, count(*) over (partition by model, target) as n from sx),
qa as materialized (select model, target, alpha, coalesce(min(case when r >= ceil((n + 1) * (1 - alpha)) then s end), 1.0) as q from rx cross join (select unnest({_ALPHAS}::double[]) as alpha) group by 1, 2, 3),
aa as (select c.model, alpha, study, bool_and(((1 - p) <= q) <> (p <= q)) as ok from cal c join qa on c.model = qa.model and c.target = qa.target group by 1, 2, 3), ta as (select model, alpha, avg(ok::int) as acceptance from aa group by 1, 2),
ba2 as (select model, min_by(alpha, [round(abs(acceptance - 0.8), 9), alpha]) as alpha from ta group by 1),
fits as materialized (select t.model, t.target, threshold, cold.a as cold, platt.a as a, platt.b as b, q from thresholds t join cold using (model, target) join platt using (model, target) join ba2 using (model) join qa on qa.model = t.model and qa.target = t.target and qa.alpha = ba2.alpha)"""


def _scores(rows: str, keys: str) -> str:
    lg = _LOGIT.format("p::double")
    return f"""select *, p >= threshold as d, (1 - p) <= q as h1, min(abs(2 * p - 1)) over w as c, round(min(abs(2 / (1 + exp(-cold * {lg})) - 1)) over w, 12) as ct,
  round(-avg(case when p >= threshold then 1 - 1 / (1 + exp(-(a * {lg} + b))) else 1 / (1 + exp(-(a * {lg} + b))) end) over w, 12) as el, bool_and(((1 - p) <= q) <> (p <= q)) over w as single, round(min(abs(p - 0.5) - abs(q - 0.5)) over w, 12) as cs
  from {rows} join fits using (model, target) window w as (partition by {keys})"""


_POLICIES = f"""{PASSES}, {_FITS}, sc1 as ({_scores("cal", "model, study")}), us as (select distinct model, study, c, ct, el from sc1),
cuts as materialized (select model, quantile_cont(c, 0.2) as plain, quantile_cont(ct, 0.2) as chill, quantile_cont(el, 0.2) as loss from us group by 1),
ev as ({_scores("(select * from passes where split = 'evaluation')", "model, condition, study")}),
pol as materialized (select site, patient, study, model, condition, target, y, unnest(['frozen', 'temp_margin', 'expected_loss', 'conformal', 'conformal_frozen']) as policy, unnest([d, d, d, h1, d]) as decision, unnest([c >= plain, ct >= chill, el >= loss, single, single]) as accepted, unnest([c, ct, el, cs, cs]) as score from ev join cuts using (model)),
pt as materialized (select site, patient, study, model, condition, policy, accepted, score, {TERM_SQL} from pol group by all)"""
_COMPARED = ("coverage_all", "evaluable_study", "cell_micro", "original")


def _policy_terms(spark, sf):
    fits = K.fit_policies(_cal(spark, sf), "model", "study", "target", _ALPHAS)
    cells = _passes(spark, sf).where("split = 'evaluation'").select("site", "patient", "study", "model", "condition", "target", "p", "y")
    return G.policy_terms(cells, ["site", "patient", "study", "model", "condition"], "model", "target", fits, T)


@query("r22_policy_gaps", f"with {_POLICIES}, {_boot('pt', 'model, condition, policy', _COMPARED)} {_gap('model, condition, policy')}")
def r22_gaps(spark, sf):
    keys = ["model", "condition", "policy"]
    return _gaps(*G.items(_policy_terms(spark, sf), _patients(spark, sf), keys, T, REPS, "b", _COMPARED), keys)


_PC = "pc as (select *, n_wrong / n_obs as error, n_wrong / n_obs > 0 as wrong from pt where condition = 'C0' and n_obs > 0)"


@query("r22_policy_ranking", f"""with {_POLICIES}, {_PC}, {_auc('site, model, policy', 'score', 'not wrong', 'pc').replace('where y is not null', '')},
po as (select *, sum(error) over w as ce, row_number() over w as k, count(*) over (partition by site, model, policy) as total from pc window w as (partition by site, model, policy order by score desc, study rows unbounded preceding)),
ar as (select site, model, policy, round(sum(ce / k) / max(total), 6) as aurc, round(sum(ce / total) / max(total), 6) as augrc from po group by 1, 2, 3) select site, model, policy, auroc as failure_auroc, aurc, augrc from ar join auc using (site, model, policy)""")
def r22_ranking(spark, sf):
    keys = ["site", "model", "policy"]
    rows = R.study_error(_policy_terms(spark, sf).where("condition = 'C0' and n_obs > 0"))
    found = R.auroc(rows, keys, "score", F.col("error") == 0).select(*keys, F.col("auroc").alias("failure_auroc"))
    return found.join(R.areas(R.curve(rows, keys, "score", "error", "study"), keys), keys)


# label sources -----------------------------------------------------------------------
#: (configuration, source cohort, labels, common cells only, policy): i and f are two sources of labels.
CONFIGURATIONS = (
    ("A0_primary", "i", "i", False, "i"), ("A1_label_swap_only", "i", "f", False, "i"), ("A1c_common_cells_i", "i", "i", True, "i"), ("A1c_common_cells_f", "i", "f", True, "i"),
    ("A2x_cohort_only", "f", "i", False, "i"), ("A2_cohort_and_labels", "f", "f", False, "i"), ("A3_second_source", "f", "f", False, "f"), ("B2_labels_and_thresholds", "i", "f", False, "f"),
)
_UNIT_F = sql_hash("'f:' || study || ':' || target")
_TWO_LABELS = f"case when {_UNIT_F} % 20 < 4 then null when {_UNIT_F} % 20 = 4 then 1 - y else y end"


def _thresholds_sql(rows: str, name: str, by: str = "model, target", w: str = "1") -> str:
    """The balanced-accuracy thresholds of rows(by, p, y), by windows over a histogram."""
    b = "least(case when (floor(p * 1000) + 1) / 1000.0::double <= p then floor(p * 1000) + 1 when floor(p * 1000) / 1000.0::double > p then floor(p * 1000) - 1 else floor(p * 1000) end, 999)::int"
    return f"""{name}_h as (select {by}, {b} as bin, coalesce(sum({w}) filter (y = 1), 0)::double as pos, coalesce(sum({w}) filter (y = 0), 0)::double as neg from {rows} where y is not null group by all),
{name}_g as (select {by}, i as bin, ap, an from (select {by}, sum(pos) as ap, sum(neg) as an from {name}_h group by all) cross join (select unnest(range(1, 1000))::int as i)),
{name}_c as (select *, sum(coalesce(pos, 0)) over w as tp, sum(coalesce(neg, 0)) over w as fp from {name}_g left join {name}_h using ({by}, bin) window w as (partition by {by} order by bin desc)),
{name}_s as (select *, (tp / nullif(ap, 0) + (an - fp) / nullif(an, 0)) / 2 as s from {name}_c),
{name} as materialized (select {by}, case when max(s) is null then 0.5 else min_by(bin, [-s, bin]) / 1000.0::double end as threshold from {name}_s group by all)"""


# the second source: cohort f leaves out every fifth study, its policy is fitted on its own labels and cohort
_SOURCES = f"""{PASSES}, ps as materialized (select *, {_TWO_LABELS} as yf, study % 5 <> 0 or site = 'external' as in_f from passes),
calf as (select model, target, p, yf as y, study from ps where condition = 'C0' and site = 'source' and split = 'calibration' and in_f), {_thresholds_sql("calf", "thf")},
cutf as (select model, quantile_cont(confidence, 0.2) as cutoff from (select model, study, min(abs(2 * p - 1)) as confidence from calf group by 1, 2) group by 1),
both2 as materialized (select x.*, t.threshold as ti, f.threshold as tf, min(abs(2 * p - 1)) over (partition by model, condition, study) as confidence, c.cutoff as ci, g.cutoff as cf from ps x join thresholds t using (model, target) join thf f using (model, target) join cutoffs c using (model) join cutf g using (model) where split = 'evaluation'),
cfg(configuration, cohort, labels, common, policy) as (values {", ".join(f"('{a}', '{b}', '{c}', {d}, '{e}')" for a, b, c, d, e in CONFIGURATIONS)}),
cc as materialized (select configuration, case when site = 'external' or cohort = 'i' then site else 'source_f' end as site, patient, study, model, condition, target, case when common and (y is null or yf is null) then null when labels = 'i' then y else yf end as y, case policy when 'i' then p >= ti else p >= tf end as decision, case policy when 'i' then confidence >= ci else confidence >= cf end as accepted from both2 cross join cfg where cohort = 'i' or in_f),
ct2 as materialized (select configuration, site, patient, study, model, condition, accepted, {TERM_SQL} from cc group by all)"""
_COHORTS = "(select site, patient from studies where split = 'evaluation' union all select 'source_f', patient from studies where split = 'evaluation' and site = 'source' and study % 5 <> 0)"


def _configured(spark, sf):
    """Evaluation cells under the eight configurations; cohort is source, source_f or external."""
    code = V.portable_hash(F.lit("f"), "study", "target") % 20
    yf = F.when(code < 4, F.lit(None)).when(code == 4, 1 - F.col("y")).otherwise(F.col("y"))
    rows = _passes(spark, sf).withColumns({"yf": yf, "in_f": (F.col("study") % 5 != 0) | (F.col("site") == "external")})
    thresholds, cut = _policy(spark, sf)
    own = rows.where("condition = 'C0' and site = 'source' and split = 'calibration' and in_f").withColumn("y", F.col("yf"))
    second = K.grid_thresholds(own, ["model", "target"]).select("model", "target", F.col("threshold").alias("tf"))
    cut_f = K.cutoffs(K.study_confidence(own, ["model", "study"]), ["model"], [0.8]).select("model", F.col("cutoff").alias("cf"))
    fits = thresholds.select("model", "target", F.col("threshold").alias("ti")).join(second, ["model", "target"]).join(cut.withColumnRenamed("cutoff", "ci"), "model").join(cut_f, "model")
    w = Window.partitionBy("model", "condition", "study")
    cells = rows.where("split = 'evaluation'").join(F.broadcast(fits), ["model", "target"]).withColumn("confidence", F.min(V.confidence("p")).over(w))
    both = F.col("y").isNotNull() & F.col("yf").isNotNull()

    def under(name, cohort, labels, common, policy):
        y = F.col("y") if labels == "i" else F.col("yf")
        d, a = (F.col("p") >= F.col(f"t{policy}")), (F.col("confidence") >= F.col(f"c{policy}"))
        site = F.col("site") if cohort == "i" else F.when(F.col("site") == "source", "source_f").otherwise(F.col("site"))
        return F.when(F.lit(cohort == "i") | F.col("in_f"), F.struct(F.lit(name).alias("configuration"), site.alias("cohort"), (F.when(both, y) if common else y).alias("label"), d.alias("decision"), a.alias("accepted")))

    each = F.explode(F.array_compact(F.array(*(under(*c) for c in CONFIGURATIONS))))
    return cells.select("patient", "study", "model", "condition", "target", each.alias("x")).select("patient", "study", "model", "condition", "target", "x.configuration", F.col("x.cohort").alias("site"), F.col("x.label").alias("y"), "x.decision", "x.accepted")


def _cohorts(spark, sf):
    rows = studies(spark, sf).where("split = 'evaluation'")
    return rows.select("site", "patient").unionByName(rows.where("site = 'source' and study % 5 <> 0").select(F.lit("source_f").alias("site"), "patient"))


_CONFIGURED = ("coverage_all", "evaluable_study", "original")


def _configured_items(spark, sf):
    """(points, draws) by configuration, with both source cohorts as the site source; each configuration has one of them."""
    keys = ["site", "patient", "study", "configuration", "model", "condition", "accepted"]
    found = G.items(R.study_terms(_configured(spark, sf), keys, T), _cohorts(spark, sf), ["configuration", "model", "condition"], T, REPS, "b", _CONFIGURED)
    return [x.withColumn("site", F.when(F.col("site") == "external", "external").otherwise("source")) for x in found]


_CB = f"{_SOURCES}, {_boot('ct2', 'configuration, model, condition', _CONFIGURED, patients=_COHORTS, pre='g')}, fpoints as (select * replace (case when site = 'external' then site else 'source' end as site) from gpoints), fdraws as materialized (select * replace (case when site = 'external' then site else 'source' end as site) from gdraws)"


@query("r20_configuration_gaps", f"with {_CB} {_gap('configuration, model, condition')}")
def r20_gaps(spark, sf):
    return _gaps(*_configured_items(spark, sf), ["configuration", "model", "condition"])


@query("r20_configuration_levels", f"with {_CB} {_estimates('fpoints', 'fdraws', 'site, configuration, model, condition')}")
def r20_levels(spark, sf):
    return G.estimates(*_configured_items(spark, sf))


_CK = "configuration, model"


def _contrast_sql(rows: str, keys: str) -> str:
    gap = lambda r: _difference(r, f"{keys}, condition", "site", *SITES)
    h1 = f"select {keys}, measure, 'H1' as hypothesis, 'gap' as contrast, '' as place, value from {gap(rows)} where condition = 'C0'"
    h2 = " union all ".join(f"select {keys}, measure, 'H2', 'interaction {c}', '', value from {_difference(gap(rows), keys, 'condition', c, 'C0')}" for c in ("C1", "C2"))
    h3 = f"select {keys}, measure, 'H3', 'gap of m2 over m1', '', value from (select {keys.replace('model', chr(39) + 'm2' + chr(39) + ' as model')}, measure, max(value) filter (model = 'm2') - max(value) filter (model = 'm1') as value from ({h1}) group by all)"
    h4 = f"select {keys}, measure, 'H4', 'C2 - C1', site, value from {_difference(rows, f'{keys}, site', 'condition', 'C2', 'C1')}"
    return f"({h1} union all {h2} union all {h3} union all {h4})"


def _contrasts(rows):
    """H1 to H4 of points or draws (..., site, model, condition, measure, value), one below the other."""
    tag = lambda df, h, c, place: df.withColumns({"hypothesis": F.lit(h), "contrast": F.lit(c), "place": place})
    gap = G.difference(rows, "site", *SITES)
    h1 = tag(gap.where("condition = 'C0'").drop("condition"), "H1", "gap", F.lit(""))
    out = h1
    for c in ("C1", "C2"):
        out = out.unionByName(tag(G.difference(gap, "condition", c, "C0"), "H2", f"interaction {c}", F.lit("")))
    h3 = G.difference(h1.drop("hypothesis", "contrast", "place"), "model", "m2", "m1").withColumn("model", F.lit("m2"))
    out = out.unionByName(tag(h3, "H3", "gap of m2 over m1", F.lit("")))
    return out.unionByName(tag(G.difference(rows, "condition", "C2", "C1").withColumnRenamed("site", "_s"), "H4", "C2 - C1", F.col("_s")).drop("_s"))


_CKEYS = "configuration, model, hypothesis, contrast, place"


@query("r20_configuration_contrasts", f"with {_CB}, cp as materialized (select * from {_contrast_sql('fpoints', _CK)} where measure <> 'coverage_all'), cd as materialized (select * from {_contrast_sql('fdraws', 'rep, ' + _CK)} where measure <> 'coverage_all') {_estimates('cp', 'cd', _CKEYS)}")
def r20_contrasts(spark, sf):
    points, draws = (_contrasts(x.where("measure <> 'coverage_all'")) for x in _configured_items(spark, sf))
    return G.estimates(points, draws)


@query("r20_factors", f"with {_SOURCES}, d as (select configuration, site, count(distinct study) as studies, count(distinct case when y is not null then study end) as evaluable, round(count(distinct case when y is not null then study end) / count(distinct study)::double, 6) as evaluable_share, round(count(y) / count(*)::double, 6) as density, round(sum(y) / count(y), 6) as positive_rate from cc where condition = 'C0' and model = 'm1' group by 1, 2), sub as (select count(*) = 0 as subset from (select study from cc where site = 'source_f' except select study from cc where site = 'source')) select d.*, subset from d cross join sub")
def r20_factors(spark, sf):
    cells = _configured(spark, sf).where("condition = 'C0' and model = 'm1'")
    ids = lambda s: cells.where(F.col("site") == s).select("study").distinct()
    missing = ids("source_f").join(ids("source"), "study", "left_anti").agg((F.count("*") == 0).alias("subset"))
    return G.described(cells, ["configuration", "site"], "study").join(F.broadcast(missing))


# other swaps -------------------------------------------------------------------------
SEEDS = ("1", "2", "3")
_PENDING = "(site = 'external' and seed = '3')"


def _swap_sql(seed: str) -> str:
    off = f"1 + {sql_hash(chr(39) + seed + ':' + chr(39) + ' || split || ' + chr(39) + ':' + chr(39) + ' || bin')} % greatest(n - 1, 1)"
    return f"""select '{seed}' as seed, t.study, g.study as donor from (select *, case when m = n or not (s between b and e) then s else (e + 1) % n end as d from (select *, max(e - b + 1) over (partition by split, bin) as m, case when n = 1 then k else (k + {off}) % n end as s from swb)) t join swb g on t.split = g.split and t.bin = g.bin and t.d = g.k
  union all select '{seed}', study, study from ctx where split is null"""


_SWAPS = f"""{SWAP}, swp as (select *, row_number() over (partition by split, bin order by patient, study) - 1 as k, count(*) over (partition by split, bin) as n from ctx where split is not null),
swb as materialized (select *, min(k) over (partition by split, bin, patient) as b, max(k) over (partition by split, bin, patient) as e from swp), sw as materialized ({" union all ".join(map(_swap_sql, SEEDS))})"""


@query("r24_swap_rows", f"with {_SWAPS} select seed, count(*) as rows, count(*) filter (x.patient <> z.patient) as others from sw join ctx x on sw.study = x.study join ctx z on sw.donor = z.study group by 1")
def r24_rows(spark, sf):
    ctx = _ctx(spark, sf)
    got = I.swaps(ctx, ["split", "bin"], "patient", "study", list(SEEDS))
    whose = lambda c, n: ctx.select(F.col("study").alias(c), F.col("patient").alias(n))
    both = got.join(whose("study", "x"), "study").join(whose("donor", "z"), "donor")
    return both.groupBy("seed").agg(F.count("*").alias("rows"), count_if(F.col("x") != F.col("z")).alias("others"))


_SWAPPED_CELLS = f"""{CELLS}, {_SWAPS}, sp as (select p.* replace (round(0.7 * p + 0.3 * {sql_unit("'d:' || donor || ':' || target")}, 4) as p), 'C2' as condition, sw.seed from predictions p join sw using (study) where split = 'evaluation' and not (site = 'external' and sw.seed = '3')),
oth as (select site, patient, study, model, target, p, y, condition, seed from (select * from passes where split = 'evaluation' and condition in ('C0', 'C1')) cross join (select unnest(['1', '2', '3']) as seed) where not {_PENDING}),
sa as (select site, patient, study, model, target, p, y, condition, seed from sp union all select * from oth),
sd as (select x.*, p >= threshold as decision, min(abs(2 * p - 1)) over (partition by seed, model, condition, study) >= cutoff as accepted from sa x join thresholds using (model, target) join cutoffs using (model)),
stt as materialized (select site, patient, study, model, condition, seed, accepted, {TERM_SQL} from sd group by all)"""
_H4K = "site, seed, model"
_R24 = lambda rows, k: f"(select {k}, measure, 'H4 (C2 - C1)' as contrast, value from {_difference(rows, k, 'condition', 'C2', 'C1')} union all select {k}, measure, 'C2 penalty (C2 - C0)', value from {_difference(rows, k, 'condition', 'C2', 'C0')})"
_RISKS = ("evaluable_study", "original")


@query("r24_swap_permutations", f"""with {_SWAPPED_CELLS}, {_boot('stt', 'seed, model, condition', _RISKS)}, e as ({_estimates(_R24('fpoints', _H4K), _R24('fdraws', 'rep, ' + _H4K), _H4K + ', contrast')})
select *, 'done' as status, case when low > 0 then 'confirmed' when high < 0 then 'opposite_direction_not_material' else 'inconclusive' end as verdict from e
union all select 'external', '3', model, null, null, null, null, null, 'pending', null from (select distinct model from predictions)""")
def r24(spark, sf):
    swaps = I.swaps(_ctx(spark, sf), ["split", "bin"], "patient", "study", list(SEEDS))
    rows = predictions(spark, sf).where("split = 'evaluation'").select("site", "patient", "study", "model", "target", "p", "y")
    absent = (F.col("site") == "external") & (F.col("seed") == "3")
    change = F.round(0.7 * F.col("p") + 0.3 * V.unit(F.lit("d"), "donor", "target"), 4)
    second = G.swapped_passes(swaps, rows, "study", "donor", change).drop("donor").withColumn("condition", F.lit("C2"))
    others = _passes(spark, sf, conditions=CONDITIONS[:2]).where("split = 'evaluation'").select(*rows.columns, "condition")
    thresholds, cut = _policy(spark, sf)

    def terms_of(cells, *more):
        decided = cells.join(F.broadcast(thresholds.select("model", "target", "threshold")), ["model", "target"]).withColumn("decision", V.decide("p", "threshold"))
        found = R.study_terms(decided, ["site", "patient", "study", "model", "condition", *more], T, scores={"confidence": F.min(V.confidence("p"))})
        return found.join(F.broadcast(cut), "model").withColumn("accepted", F.col("confidence") >= F.col("cutoff"))

    # what no swap changes is the same under every seed, so its studies are copied and not its cells
    same = terms_of(others).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    terms = terms_of(second, "seed").unionByName(same).where(~absent)
    points, draws = G.items(terms, _patients(spark, sf), ["seed", "model", "condition"], T, REPS, "b", _RISKS)
    named = lambda df, c, minus: G.difference(df, "condition", "C2", minus).withColumn("contrast", F.lit(c))
    pair = lambda df: named(df, "H4 (C2 - C1)", "C1").unionByName(named(df, "C2 penalty (C2 - C0)", "C0"))
    got = G.estimates(pair(points), pair(draws))
    done = got.withColumns({"status": F.lit("done"), "verdict": B.verdict(F.col("value"), F.col("low"), F.col("high"), "greater_or_equal", None)})
    pending = rows.select("model").distinct().select(F.lit("external").alias("site"), F.lit("3").alias("seed"), "model", F.lit("pending").alias("status"))
    return done.unionByName(pending, allowMissingColumns=True)


# refitted policies -------------------------------------------------------------------
_CALP = "(select site, patient from studies where site = 'source' and split = 'calibration')"
_REFIT = f"""{CELLS}, kp as (select site, patient, row_number() over (order by patient) - 1 as i, count(*) over () as n from (select distinct site, patient from {_CALP})), {counts_cte(CURVE_REPS, "k", "kp", "kc")},
kx as (select rep, model, target, p, y, n from cal join kc using (site, patient)), {_thresholds_sql("kx", "kt", "rep, model, target", "n")},
kv as (select rep, model, confidence, unnest(range(n)) from (select rep, model, study, any_value(n) as n, min(abs(2 * p - 1)) as confidence from cal join kc using (site, patient) group by 1, 2, 3)),
ku as materialized (select rep, model, quantile_cont(confidence, 0.2) as cutoff from kv group by 1, 2),
kd as (select c.site, c.model, c.study, c.target, c.y, kt.rep, c.p >= kt.threshold as decision, c.confidence >= ku.cutoff as accepted from cells c join kt on c.model = kt.model and c.target = kt.target join ku on ku.model = c.model and ku.rep = kt.rep where condition = 'C0'),
kterms as (select site, rep, model, study, accepted, {TERM_SQL} from kd group by all),
kl as (select rep, site, model, {_sql_measures(_RISKS)} from (select rep, site, model, {", ".join(f"sum(case when accepted then {c} else 0 end) as a_{c}, sum({c}) as all_{c}" for c in TERMS)} from kterms group by all)),
kg as materialized (select rep, model, measure, value from {_difference("kl", "rep, model", "site", *SITES)}),
kpt as (select site, model, {_sql_measures(_RISKS)} from (select site, model, {", ".join(f"sum(case when accepted then {c} else 0 end) as a_{c}, sum({c}) as all_{c}" for c in TERMS)} from terms where condition = 'C0' group by all)),
kpg as (select model, measure, value as point from {_difference("kpt", "model", "site", *SITES)}),
kset as (select model, round(stddev_samp(cutoff), 6) as cutoff_sd from ku group by 1), ktset as (select model, {", ".join(f"round(stddev_samp(threshold) filter (target = '{t}'), 6) as threshold_sd_{t}" for t in T)} from kt group by 1),
k10 as (select model, measure, count(value) as replicates, round(any_value(point), 6) as point, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.975), 6) as high from kg join kpg using (model, measure) group by 1, 2)"""


def _refits(spark, sf):
    """K10's rows: calibration patients are drawn again, thresholds and cutoff selected anew, evaluation stays."""
    cal = _cal(spark, sf)
    patients = studies(spark, sf).where("site = 'source' and split = 'calibration'").select("site", "patient")
    hist = K.grid_histogram(cal, ["site", "patient", "model", "target"])
    # both are read several times
    weighed, _ = kept(B.replicate_sums(hist, patients, "site", "patient", ["model", "target", "bin"], ["pos", "neg"], CURVE_REPS, "k").drop("site"), "weighed")
    thresholds, _ = kept(K.best_on_grid(weighed, ["rep", "model", "target"]).select("rep", "model", "target", "threshold"), "thresholds")
    confidence = B.with_weights(K.study_confidence(cal, ["site", "patient", "model", "study"]), patients, "site", "patient", CURVE_REPS, "k")
    cutoffs, _ = kept(G.weighted_cutoffs(confidence, ["model"], "confidence", 0.2), "cutoffs")
    cells = predictions(spark, sf).where("split = 'evaluation'").select("site", "model", "study", "target", "p", "y")
    moved = G.difference(G.measures(G.policy_replicates(cells, thresholds, cutoffs, T), ["rep", "site", "model"], T, _RISKS), "site", *SITES)
    frozen = R.accepted_sums(_terms(spark, sf).where("condition = 'C0'"), ["site", "model"], T)
    settings = thresholds.select("rep", "model", F.col("target").alias("setting"), F.col("threshold").alias("value")).unionByName(cutoffs.select("rep", "model", F.lit("cutoff").alias("setting"), F.col("cutoff").alias("value")))
    return K.calibration_uncertainty(moved, G.difference(G.measures(frozen, ["site", "model"], T, _RISKS), "site", *SITES), settings, ["measure"], "model")


@query("k10_calibration_uncertainty", f"with {_REFIT} select * from k10 join kset using (model) join ktset using (model)")
def k10(spark, sf):
    return _refits(spark, sf)


_R28 = _gap("model, condition")


@query("r28_uncertainty_ratio", f"with {_REFIT}, {_boot('terms', 'model, condition', _RISKS)}, ev as (select * from ({_R28}) where condition = 'C0'), x as (select k10.model, measure, sd, round((ev.high - ev.low) / 3.92, 6) as evaluation_sd, round(sd / nullif((ev.high - ev.low) / 3.92, 0), 6) as ratio from k10 join ev using (model, measure)) select *, min(ratio) over (partition by measure) as least, max(ratio) over (partition by measure) as most from x")
def r28(spark, sf):
    gaps = _gaps(*G.items(_terms(spark, sf), _patients(spark, sf), ["model", "condition"], T, REPS, "b", _RISKS), ["model", "condition"]).where("condition = 'C0'")
    refits = _refits(spark, sf).select("model", "measure", "sd")
    got = B.uncertainty_ratio(gaps, refits, ["model", "measure"]).join(refits, ["model", "measure"])
    w = Window.partitionBy("measure")
    return got.select("model", "measure", "sd", "evaluation_sd", "ratio", F.min("ratio").over(w).alias("least"), F.max("ratio").over(w).alias("most"))


# ranking, expert reference and condition rows ----------------------------------------
_LG = lambda x: _LOGIT.format(x)
_FAIL = f"""fs as (select site, model, study, target, abs(2 * p - 1) as confidence, abs({_LG('p::double')} - {_LG('threshold::double')}) as margin, case when y is not null then decision::int <> y end as wrong from cells join thresholds using (model, target) where condition = 'C0'),
fb as (select site, model, 'study' as level, 'all' as target, min(confidence) as confidence, min(margin) as margin, bool_or(wrong) as wrong from fs group by site, model, study union all select site, model, 'cell', target, confidence, margin, wrong from fs),
fl as (select site, model, level, target, wrong, unnest(['confidence', 'margin']) as score, unnest([confidence, margin]) as s from fb where wrong is not null)"""


@query("r11_failure_detection", f"with {CELLS}, {_FAIL}, {_auc('site, model, level, target, score', 's', 'not wrong', 'fl').replace('where y is not null', '')}, n as (select site, model, level, target, score, count(*) as n, round(avg(wrong::int), 6) as error_share from fl group by all) select site, model, level, target, score, n, error_share, auroc from n join auc using (site, model, level, target, score)")
def r11(spark, sf):
    return G.failure_detection(_cells(spark, sf).where("condition = 'C0'"), ["site", "model", "study"], ["site", "model"])


_VARIANTS = ("expert", "primary", "unmentioned_negative", "uncertain_positive")
_EXPERT = f"""xr as (select site, model, patient, study, target, decision, confidence >= cutoff as accepted, unnest(['expert', 'primary', 'unmentioned_negative', 'uncertain_positive']) as labels, unnest([({sql_unit("'x:' || study || ':' || target")} < 0.4)::int::double, y, case when raw is null then 0.0 else y end, case when raw = -1 then 1.0 else y end]) as y from cells where condition = 'C0' and site = 'external'),
xt as materialized (select 'expert' as site, study as patient, study, model, labels, accepted, {TERM_SQL} from xr group by all)"""


@query("r23_expert_reference", f"with {CELLS}, {_EXPERT}, {_boot('xt', 'model, labels', ('evaluable_study',), patients='xt')}, n as (select model, labels, count(*) as studies, count(*) filter (accepted) as accepted, (count(*) filter (accepted and evaluable > 0)) as evaluable_accepted from xt group by 1, 2) select model, labels, studies, accepted, evaluable_accepted, value as selective_error, low, high from ({_estimates('fpoints', 'fdraws', 'model, labels')}) join n using (model, labels)")
def r23(spark, sf):
    """Selective error against the expert and three variants of the report's labels; studies are drawn, as patients have few of them."""
    expert = F.when(V.unit(F.lit("x"), "study", "target") < 0.4, 1.0).otherwise(0.0)
    of = lambda v: F.struct(F.lit(v).alias("labels"), F.when(V.label_variant("raw", v)["mask"], V.label_variant("raw", v)["label"]).alias("label"))
    each = F.explode(F.array(F.struct(F.lit("expert").alias("labels"), expert.alias("label")), *map(of, _VARIANTS[1:])))
    cells = _cells(spark, sf).where("condition = 'C0' and site = 'external'").withColumn("x", each).select("model", "study", "target", "decision", "accepted", "x.labels", F.col("x.label").alias("y"))
    terms = R.study_terms(cells, ["model", "study", "labels", "accepted"], T).withColumns({"site": F.lit("expert"), "patient": F.col("study")})
    points, draws = G.items(terms, terms.select("site", "patient"), ["model", "labels"], T, REPS, "b", ("evaluable_study",))
    sizes = terms.groupBy("model", "labels").agg(F.count("*").alias("studies"), count_if(F.col("accepted")).alias("accepted"), count_if(F.col("accepted") & (F.col("evaluable") > 0)).alias("evaluable_accepted"))
    return G.estimates(points, draws).withColumnRenamed("value", "selective_error").drop("site", "measure").join(sizes, ["model", "labels"])


_CROW = f"""cr as (select *, n_wrong / nullif(n_obs, 0) as error from terms), cw as (select *, sum(error) over w as ce, row_number() over w as k, count(*) over (partition by site, model, condition) as total from cr where error is not null window w as (partition by site, model, condition order by confidence desc, study rows unbounded preceding)),
ca as (select site, model, condition, round(sum(ce / k) / max(total), 6) as aurc from cw group by 1, 2, 3), cf as (select *, error > 0 as wrong from cr where error is not null), {_auc('site, model, condition', 'confidence', 'not wrong', 'cf').replace('where y is not null', '')},
cs as (select site, model, condition, count(*) as studies, round(avg(n_wrong / 3) filter (n_obs = 3), 6) as hamming, round(avg((n_wrong > 0)::int) filter (n_obs = 3), 6) as any_label, round(avg(confidence), 6) as mean_confidence, round(avg(error) filter (accepted), 6) as selective_risk, round(count(*) filter (accepted) / count(*)::double, 6) as coverage from cr group by 1, 2, 3)"""
_CONDITION = ["site", "model", "condition"]


@query("r27_condition_row", f"with {CELLS}, {_CROW} select cs.*, aurc, auroc as failure_auroc from cs join ca using (site, model, condition) join auc using (site, model, condition)")
def r27(spark, sf):
    rows = R.study_error(_terms(spark, sf))
    full = F.col("n_obs") == len(T)
    r = lambda c: F.round(c, 6)
    got = rows.groupBy(*_CONDITION).agg(
        F.count("*").alias("studies"), r(F.avg(F.when(full, F.col("n_wrong") / len(T)))).alias("hamming"), r(F.avg(F.when(full, (F.col("n_wrong") > 0).cast("double")))).alias("any_label"), r(F.avg("confidence")).alias("mean_confidence"),
        r(F.avg(F.when(F.col("accepted"), F.col("error")))).alias("selective_risk"), r(F.count_if("accepted") / F.count("*")).alias("coverage"),
    )
    area = R.areas(R.curve(rows, _CONDITION, "confidence", "error", "study"), _CONDITION).select(*_CONDITION, "aurc")
    failure = R.auroc(rows.where("error is not null"), _CONDITION, "confidence", F.col("error") == 0).select(*_CONDITION, F.col("auroc").alias("failure_auroc"))
    return got.join(area, _CONDITION).join(failure, _CONDITION)


_CT = "site, model, condition, target"


@query("r27_target_rows", f"""with {CELLS}, {_auc(_CT, 'p', 'y = 1', 'cells')}, ap as (select {_CT}, round(sum(pos * cp / cn::double) / nullif(sum(pos), 0), 6) as average_precision from (select *, sum(pos) over w as cp, sum(n) over w as cn from (select {_CT}, p, count(*) filter (y = 1) as pos, count(*) as n from cells where y is not null group by all) window w as (partition by {_CT} order by p desc)) group by all),
be as (select {_CT}, round(avg((decision::int <> y)::int) filter (y is not null), 6) as binary_error, round(avg((p - y) ** 2), 6) as brier from cells group by all) select {_CT}, binary_error, auroc, average_precision, brier from be join auc using ({_CT}) join ap using ({_CT})""")
def r27_targets(spark, sf):
    by = [*_CONDITION, "target"]
    rows = _cells(spark, sf)
    wrong = rows.groupBy(*by).agg(F.round(F.avg(F.when(F.col("y").isNotNull(), (F.col("decision").cast("double") != F.col("y")).cast("double"))), 6).alias("binary_error"))
    return wrong.join(R.auroc(rows, by, "p", F.col("y") == 1).select(*by, "auroc"), by).join(R.average_precision(rows, by, "p", F.col("y") == 1), by).join(R.brier(rows, by), by)


@query("a42_decision_identity", f"with {CELLS}, c as (select a.model, a.study, abs(a.p - b.p) as d, a.decision <> b.decision as x, (a.confidence >= a.cutoff) <> (b.confidence >= b.cutoff) as z from cells a join cells b on a.model = b.model and a.study = b.study and a.target = b.target and a.condition = 'C0' and b.condition = 'C1') select model, round(max(d), 6) as difference, count(*) filter (x) as decisions, count(distinct case when z then study end) as acceptances from c group by 1")
def a42(spark, sf):
    rows = _cells(spark, sf)
    return R.decision_identity(rows.where("condition = 'C0'"), rows.where("condition = 'C1'"), ["model", "study", "target"], ["model", "study"], ["model"])


@query("r16_threshold_free", f"""with {CURVE}, kp as (select site, patient, row_number() over (partition by site order by patient) - 1 as i, count(*) over (partition by site) as n from (select distinct site, patient from {EVALUATION})), {counts_cte(CURVE_REPS, "b", "kp", "kc")},
cw as (select c.site, c.model, rep, c.study, n::double as w, x.error, x.confidence from curve c join c0 x on c.site = x.site and c.model = x.model and c.study = x.study join kc k on x.site = k.site and x.patient = k.patient),
rc as (select *, sum(w) over o as cw, sum(w * error) over o as ce, sum(w) over (partition by site, model, rep) as tot from cw window o as (partition by site, model, rep order by confidence desc, study rows unbounded preceding)),
ra as (select site, model, rep, unnest(['aurc', 'augrc']) as measure, unnest([round(sum(w * ce / cw) / max(tot), 6), round(sum(w * ce) / (max(tot) * max(tot)), 6)]) as value from rc group by 1, 2, 3),
pa as (select site, model, unnest(['aurc', 'augrc']) as measure, unnest([round(sum(risk) / max(total), 6), round(sum(cum_we / total) / max(total), 6)]) as value from curve group by 1, 2)
{_estimates(_difference("pa", "model", "site", *SITES), _difference("ra", "rep, model", "site", *SITES), "model")}""")
def r16(spark, sf):
    c0, by = _c0(spark, sf), ["site", "model"]
    weighed = B.with_weights(c0, _patients(spark, sf), "site", "patient", CURVE_REPS, "b")
    long = lambda df, keys: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("aurc", "augrc")))).alias("x")).select(*keys, "x.*")
    draws = long(G.weighted_areas(weighed, by, "confidence", "error", "study"), ["rep", *by])
    points = long(R.areas(R.curve(c0, by, "confidence", "error", "study"), by), by)
    return G.estimates(G.difference(points, "site", *SITES), G.difference(draws, "site", *SITES))


# calibration error, coverage at a risk, false discovery --------------------------------
_LEVELS = [0.05, 0.1, 0.2, 0.3]


@query("r29_coverage_at_risk", f"""with {C0}, g as (select site, model, confidence, count(*) as n, sum(error) as e from c0 where error is not null group by 1, 2, 3), r as (select *, sum(n) over w as cn, sum(e) over w as ce, sum(n) over (partition by site, model) as total from g window w as (partition by site, model order by confidence desc)),
l as (select distinct site, model, unnest({_LEVELS}::double[]) as level from g), m as (select site, model, level, max(cn / total::double) as s, min(confidence) as cutoff from r join l using (site, model) where round(ce / cn, 12) <= level group by 1, 2, 3)
select site, model, level, round(coalesce(s, 0), 6) as coverage, cutoff from l left join m using (site, model, level)""")
def r29(spark, sf):
    return L.coverage_at_risk(_c0(spark, sf), ["site", "model"], "confidence", "error", _LEVELS)


_MT = "site, model, target"
_ECE = "sum(n)::bigint as cells, count(*) as bins, round(sum(abs(sp / n - sy / n) * n) / sum(n), 6) as ece, round(max(abs(sp / n - sy / n)), 6) as mce"


@query("r30_calibration_error", f"with {PREDICTIONS}, b as (select {_MT}, least(floor(p * 15), 14) as bin, count(*)::double as n, sum(p) as sp, sum(y) as sy from predictions where y is not null group by all) select {_MT}, {_ECE} from b group by all")
def r30(spark, sf):
    return L.calibration_error(predictions(spark, sf), ["site", "model", "target"])


@query("r30_equal_mass_error", f"with {PREDICTIONS}, g as (select {_MT}, p, count(*) as n, sum(y) as sy from predictions where y is not null group by all), r as (select *, sum(n) over (partition by {_MT} order by p) - n as before, sum(n) over (partition by {_MT}) as total from g), b as (select {_MT}, before * 15 // total as bin, sum(n)::double as n, sum(p * n) as sp, sum(sy) as sy from r group by all) select {_MT}, {_ECE} from b group by all")
def r30_mass(spark, sf):
    return L.equal_mass_error(predictions(spark, sf), ["site", "model", "target"])


@query("w9_benjamini_hochberg", "with p as (select c_nationkey as family, c_custkey as name, (c_custkey * 37 % 1000) / 1000.0::double as p from customer), k as (select *, row_number() over (partition by family order by p, name) as i, count(*) over (partition by family) as m from p) select family, name, p, round(min(least(1.0, p * m / i)) over (partition by family order by i desc), 6) as bh from k")
def w9_bh(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("name"), (F.col("c_custkey") * 37 % 1000 / F.lit(1000.0)).alias("p"))
    return B.benjamini_hochberg(rows, ["family"], "name", "p")
