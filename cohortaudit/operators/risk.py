"""Selective risk, coverage, curves, ranking metrics and decompositions.

Studies' terms come first: counts and errors from which every estimator is a ratio of
sums. A study's terms carry one column a target: wrong_<target> and obs_<target>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.functions import values as V
from cohortaudit.operators.audit import DIGITS, count_if, ratio
from cohortaudit.operators.prefix import ranged, running_sums
from cohortaudit.sources.scratch import kept

ESTIMATORS = ("original", "evaluable_study", "cell_micro", "pathology_macro")


def term_columns(targets: list[str]) -> list[str]:
    """The sums that estimators need, in order."""
    return ["one", "evaluable", "e_orig", "n_wrong", "n_obs", *(f"wrong_{t}" for t in targets), *(f"obs_{t}" for t in targets)]


def image_to_study(df: DataFrame, keys: list[str], p: str, labels: list[str], fixed: list[str]) -> DataFrame:
    """Mean probability, first labels, image count, by study; a study whose labels or fixed fields differ between images raises when read."""
    same = [F.count_distinct(c) <= 1 for c in (*labels, *fixed)]
    good = reduce(lambda a, b: a & b, same)
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in (*labels, *fixed)]
    got = df.groupBy(*keys).agg(F.avg(p).alias("_p"), F.count("*").alias("images"), *firsts, good.alias("_good"))
    checked = F.when(F.col("_good"), F.col("_p")).otherwise(F.raise_error(F.lit("images of a study disagree")).cast("double"))
    return got.withColumn(p, checked).drop("_p", "_good")


def external_labels(df: DataFrame, keys: list[str], v: str, *order: str) -> DataFrame:
    """By study: the first observed 0 or 1, else -1 if any is uncertain, else null."""
    seen = F.min_by(F.when(F.col(v).isin(0.0, 1.0), F.col(v)), F.when(F.col(v).isin(0.0, 1.0), F.struct(*order)))
    return df.groupBy(*keys).agg(F.coalesce(seen, F.when(F.coalesce(F.bool_or(F.col(v) == -1), F.lit(False)), -1.0)).alias(v))


def study_terms(cells: DataFrame, keys: list[str], targets: list[str], target: str = "target", decision: str = "decision", y: str = "y", scores: dict[str, Column] | None = None) -> DataFrame:
    """(keys, scores, terms): a row for each study from its (target, decision, y) cells; cells without a label are not observed.

    scores are further aggregates over a study's cells, by name.
    """
    more = scores or {}
    obs = F.col(y).isNotNull()
    wrong = obs & (F.col(decision).cast("double") != F.col(y))
    one = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)).cast("double")
    of = lambda t, c: one((F.col(target) == t) & c)
    got = cells.groupBy(*keys).agg(*(c.alias(k) for k, c in more.items()), one(wrong).alias("n_wrong"), one(obs).alias("n_obs"), *(of(t, wrong).alias(f"wrong_{t}") for t in targets), *(of(t, obs).alias(f"obs_{t}") for t in targets))
    return _of_study(got).select(*keys, *more, *term_columns(targets))


def _of_study(df: DataFrame) -> DataFrame:
    return df.withColumns({"one": F.lit(1.0), "evaluable": F.when(F.col("n_obs") > 0, 1.0).otherwise(0.0), "e_orig": F.col("n_wrong") / F.greatest(F.col("n_obs"), F.lit(1.0))})


def wide_terms(studies: DataFrame, keys: list[str], targets: list[str], decision: str = "decision", y: str = "y", copies: str | None = None) -> DataFrame:
    """(keys, terms): study_terms of rows that are a study each, with its cells' decision_<target> and y_<target> beside each other; copies: how often each cell counts."""
    n = F.col(copies) if copies else F.lit(1)
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0).cast("double")
    wrong = {f"wrong_{t}": one(F.col(f"{decision}_{t}").cast("double") != F.col(f"{y}_{t}")) for t in targets}
    obs = {f"obs_{t}": one(F.col(f"{y}_{t}").isNotNull()) for t in targets}
    total = lambda names: reduce(lambda a, b: a + b, map(F.col, names))
    got = studies.withColumns(wrong | obs).withColumns({"n_wrong": total(wrong), "n_obs": total(obs)})
    return _of_study(got).select(*keys, *term_columns(targets))


def study_error(terms: DataFrame) -> DataFrame:
    """Terms with error_zero (no label counts as 0) and error (no label is null)."""
    return terms.withColumns({"error_zero": F.col("e_orig"), "error": F.try_divide("n_wrong", "n_obs")})


def fully_observed(terms: DataFrame, targets: list[str]) -> DataFrame:
    """One row: mean Hamming error and any-label error of fully observed studies, and each target's error among observed cells."""
    full = F.col("n_obs") == len(targets)
    return terms.agg(
        count_if(full).alias("studies"), F.round(F.avg(F.when(full, F.col("n_wrong") / len(targets))), DIGITS).alias("hamming"), F.round(F.avg(F.when(full, F.when(F.col("n_wrong") > 0, 1.0).otherwise(0.0))), DIGITS).alias("any_label"),
        *(ratio(F.sum(f"wrong_{t}"), F.sum(f"obs_{t}")).alias(f"error_{t}") for t in targets),
    )


def selective_risk(df: DataFrame, by: list[str], error: str, accepted: Column) -> DataFrame:
    """By group: studies, accepted, coverage, risk among accepted (null with none), risk over all."""
    return df.groupBy(*by).agg(F.count("*").alias("studies"), count_if(accepted).alias("accepted"), ratio(count_if(accepted), F.count("*")).alias("coverage"), F.round(F.avg(F.when(accepted, F.col(error))), DIGITS).alias("risk"), F.round(F.avg(error), DIGITS).alias("full_risk"))


def accepted_sums(terms: DataFrame, by: list[str], targets: list[str], accepted: str = "accepted") -> DataFrame:
    """(by, a_<term>, all_<term>): sums over accepted and over all studies."""
    c = term_columns(targets)
    return terms.groupBy(*by).agg(*(F.sum(F.when(F.col(accepted), F.col(x)).otherwise(0.0)).alias(f"a_{x}") for x in c), *(F.sum(x).alias(f"all_{x}") for x in c))


def estimators(targets: list[str], prefix: str = "a_") -> dict[str, Column]:
    """The estimators as columns over sums; a macro risk averages the targets with a labelled cell; nothing accepted gives null."""
    s = lambda n: F.col(prefix + n)
    ratio_of = lambda a, b: F.when(b > 0, F.try_divide(a, b))
    per = {t: ratio_of(s(f"wrong_{t}"), s(f"obs_{t}")) for t in targets}
    known = F.array_compact(F.array(*per.values()))
    macro = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double"))
    return {"original": ratio_of(s("e_orig"), s("one")), "evaluable_study": ratio_of(s("e_orig"), s("evaluable")), "cell_micro": ratio_of(s("n_wrong"), s("n_obs")), "pathology_macro": macro} | {f"pathology_{t}": r for t, r in per.items()}


def needed_sums(targets: list[str], names: list[str] | tuple[str, ...]) -> list[str]:
    """The columns of accepted_sums that estimators and coverages are ratios of."""
    per = {t: [f"a_wrong_{t}", f"a_obs_{t}"] for t in targets}
    parts = {"coverage_all": ["a_one", "all_one"], "coverage_evaluable": ["a_evaluable", "all_evaluable"], "original": ["a_e_orig", "a_one"], "evaluable_study": ["a_e_orig", "a_evaluable"], "cell_micro": ["a_n_wrong", "a_n_obs"], "pathology_macro": sum(per.values(), [])}
    parts |= {f"pathology_{t}": c for t, c in per.items()}
    return sorted({c for n in names for c in parts[n]})


def summarise(sums: DataFrame, by: list[str], targets: list[str]) -> DataFrame:
    """Counts, coverage over all and over evaluable studies, and every risk, accepted and at full coverage."""
    i = lambda n: F.col(n).cast("long")
    rnd = lambda d, p: [F.round(c, DIGITS).alias(f"{p}{k}") for k, c in d.items()]
    full = {k: c for k, c in estimators(targets, "all_").items() if k in ESTIMATORS}
    return sums.select(
        *by, i("all_one").alias("studies"), i("all_evaluable").alias("evaluable_studies"), i("a_one").alias("accepted_studies"), i("a_evaluable").alias("accepted_evaluable"), ratio(F.col("a_one"), F.col("all_one")).alias("coverage_all"),
        ratio(F.col("a_evaluable"), F.col("all_evaluable")).alias("coverage_evaluable"), i("a_n_obs").alias("cells_accepted"), i("all_n_obs").alias("cells_all"), *rnd(estimators(targets), "risk_"), *rnd(full, "full_"),
    )


def contrasts(levels: DataFrame, model: str, site: str, condition: str, value: str, source: str, external: str, base: str, other: str) -> DataFrame:
    """By model: transport gap of the base condition, penalties of the other condition at both sites, and their interaction."""
    at = lambda s, c: F.max(F.when((F.col(site) == s) & (F.col(condition) == c), F.col(value)))
    got = levels.groupBy(model).agg(at(source, base).alias("s0"), at(external, base).alias("e0"), at(source, other).alias("s1"), at(external, other).alias("e1"))
    d = lambda a, b: F.round(F.col(a) - F.col(b), DIGITS)
    return got.select(model, d("e0", "s0").alias("gap"), d("s1", "s0").alias("penalty_source"), d("e1", "e0").alias("penalty_external"), F.round((F.col("e1") - F.col("e0")) - (F.col("s1") - F.col("s0")), DIGITS).alias("interaction"))


def curve(df: DataFrame, by: list[str], confidence: str, error: str, key: str, weight: str | None = None) -> DataFrame:
    """Rows with an error, most confident first (ties by key), with cumulative weight, weighted error, coverage and risk."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(error).isNotNull()).select(*by, key, F.col(confidence).alias("_c"), w.alias("w"), (w * F.col(error)).alias("we"))
    run = running_sums(rows, by, [("_c", True), (key, False)], ["w", "we"])
    totals = rows.groupBy(*by).agg(F.sum("w").alias("total"))
    return run.join(F.broadcast(totals), by).withColumns({"coverage": F.col("cum_w") / F.col("total"), "risk": F.coalesce(F.try_divide("cum_we", "cum_w"), F.lit(0.0))})


def curve_at(points: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """(by, grid, risk): the risk at the first coverage that reaches each grid value (the last one where none does)."""
    # a row answers the values between the coverage before it and its own, so the curve isn't copied;
    # the margin lets a neighbour answer too where sums of weights round, and min_by picks
    before = (F.col("cum_w") - F.col("w")) / F.col("total")
    values = F.array(*map(F.lit, grid))
    hits = points.select(*by, "coverage", "risk", F.explode(F.filter(values, lambda g: (g <= F.col("coverage")) & ((g > before - 1e-9) | (before <= 0)))).alias("grid"))
    first = hits.groupBy(*by, "grid").agg(F.min_by("risk", "coverage").alias("risk"))
    last = points.groupBy(*by).agg(F.max_by("risk", "coverage").alias("_last")).withColumn("grid", F.explode(values))
    return last.join(first, [*by, "grid"], "left").select(*by, "grid", F.round(F.coalesce("risk", "_last"), DIGITS).alias("risk"))


def areas(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, aurc, augrc) of a curve."""
    return points.groupBy(*by).agg(F.round(F.sum(F.col("w") * F.col("risk")) / F.max("total"), DIGITS).alias("aurc"), F.round(F.sum(F.col("w") * F.col("cum_we") / F.col("total")) / F.max("total"), DIGITS).alias("augrc"))


def _by_score(df: DataFrame, by: list[str], score: str, positive: Column, weight: str | None, descending: bool) -> DataFrame:
    """Distinct scores with their positive and negative weight and running sums of both."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(positive.isNotNull() & F.col(score).isNotNull()).select(*by, F.col(score).alias("_s"), F.when(positive, w).otherwise(0.0).alias("pos"), F.when(positive, 0.0).otherwise(w).alias("neg"))
    per = rows.groupBy(*by, "_s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return running_sums(per, by, [("_s", descending)], ["pos", "neg"])


def auroc(df: DataFrame, by: list[str], score: str, positive: Column, weight: str | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auroc): the chance that a positive scores above a negative, ties half; null with one class."""
    run = _by_score(df, by, score, positive, weight, False)
    u = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return run.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.round(F.try_divide(u, F.sum("pos") * F.sum("neg")), DIGITS).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """(by, average_precision): the sum of recall steps times precision, scores descending; null without positives."""
    run = _by_score(df, by, score, positive, None, True)
    area = F.sum(F.col("pos") * F.try_divide("cum_pos", F.col("cum_pos") + F.col("cum_neg")))
    return run.groupBy(*by).agg(F.round(F.try_divide(area, F.sum("pos")), DIGITS).alias("average_precision"))


def brier(df: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """(by, brier): the mean squared difference over labelled cells."""
    return df.groupBy(*by).agg(F.round(F.avg(F.pow(F.col(p) - F.col(y), 2)), DIGITS).alias("brier"))


def masked_loss(df: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """(by, loss): binary cross-entropy summed over labelled cells, over max(their number, 1)."""
    q = F.least(F.greatest(F.col(p), F.lit(V.CLIP)), F.lit(1 - V.CLIP))
    bce = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    return df.groupBy(*by).agg(F.round(F.coalesce(F.sum(bce), F.lit(0.0)) / F.greatest(F.count(y), F.lit(1)), DIGITS).alias("loss"))


def macro(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, macro): the mean over targets, those without a value left out."""
    return df.groupBy(*by).agg(F.round(F.avg(value), DIGITS).alias("macro"))


def operating(cells: DataFrame, by: list[str], accepted: str = "accepted", decision: str = "decision", y: str = "y") -> DataFrame:
    """Confusion counts and rates by group and scope (all, accepted)."""
    scope = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col(accepted), "accepted"))))
    rows = cells.where(F.col(y).isNotNull()).withColumn("scope", scope)
    d, t = F.col(decision), F.col(y) == 1
    tp, fp, fn, tn = count_if(d & t), count_if(d & ~t), count_if(~d & t), count_if(~d & ~t)
    return rows.groupBy(*by, "scope").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(fp + fn, F.count("*")).alias("error"), ratio(tp + fp, F.count("*")).alias("positive_rate"))


def subgroups(df: DataFrame, by: list[str], group: str, error: str, accepted: str, least: int = 1) -> DataFrame:
    """Risk and coverage by subgroup with at least `least` studies."""
    return selective_risk(df, [*by, group], error, F.col(accepted)).where(F.col("studies") >= least)


def disparity(groups: DataFrame, by: list[str], group: str) -> DataFrame:
    """(by): largest coverage difference between subgroups, the highest risk and its subgroup (ties by name)."""
    worst = F.max_by(F.struct("risk", group), F.when(F.col("risk").isNotNull(), F.struct("risk", group)))
    return groups.groupBy(*by).agg(F.round(F.max("coverage") - F.min("coverage"), DIGITS).alias("coverage_disparity"), worst.alias("w")).select(*by, "coverage_disparity", F.col("w.risk").alias("worst_risk"), F.col(f"w.{group}").alias("worst_group"))


def decomposition(df: DataFrame, by: list[str], study: str, condition: str, base: str, other: str, error: str = "error", accepted: str = "accepted") -> DataFrame:
    """One row a group: the policy effect as prediction and selection changes in both orders, the full-cohort effect, and the Jaccard index of acceptance.

    Risks are means of errors over evaluable studies of an accepted set.
    """
    at = lambda c, v: F.max(F.when(F.col(condition) == c, F.col(v)))
    wide = df.groupBy(*by, study).agg(at(base, error).alias("e0"), at(other, error).alias("e1"), at(base, accepted).alias("a0"), at(other, accepted).alias("a1"))
    mean = lambda e, a: F.avg(F.when(F.col(a), F.col(e))) if a else F.avg(e)
    r = wide.groupBy(*by).agg(
        mean("e0", "a0").alias("r00"), mean("e1", "a1").alias("r11"), mean("e1", "a0").alias("r10"), mean("e0", "a1").alias("r01"), mean("e0", None).alias("f0"), mean("e1", None).alias("f1"),
        count_if(F.col("a0") & F.col("a1")).alias("both"), count_if(F.col("a0") | F.col("a1")).alias("either"),
    )
    d = lambda a, b: F.round(F.col(a) - F.col(b), DIGITS)
    return r.select(
        *by, d("r11", "r00").alias("policy_effect"), d("r10", "r00").alias("prediction_first"), d("r11", "r10").alias("selection_second"), d("r01", "r00").alias("selection_first"), d("r11", "r01").alias("prediction_second"),
        d("f1", "f0").alias("full_cohort"), ratio(F.col("both"), F.col("either")).alias("jaccard"),
    )


def coverage_drift(levels: DataFrame, by: list[str], site: str, coverage: str, source: str, external: str, limit: float = 0.05) -> DataFrame:
    """External minus source coverage and whether it is past the limit."""
    at = lambda s: F.max(F.when(F.col(site) == s, F.col(coverage)))
    d = at(external) - at(source)
    return levels.groupBy(*by).agg(F.round(d, DIGITS).alias("drift"), (F.abs(d) > limit).alias("flagged"))


def label_audit(cells: DataFrame, by: list[str], target: str, study: str, raw: str = "raw") -> DataFrame:
    """Counts and rates of states by target, and over `all` targets."""
    v = F.col(raw)
    rows = cells.withColumn(target, F.explode(F.array(F.col(target), F.lit("all"))))
    return rows.groupBy(*by, target).agg(F.count("*").alias("cells"), count_if(v == 1).alias("pos"), count_if(v == 0).alias("neg"), count_if(v == -1).alias("unc"), count_if(v.isNull()).alias("unm"), ratio(count_if(v.isin(0.0, 1.0)), F.count("*")).alias("density"), ratio(count_if(v == 1), count_if(v.isin(0.0, 1.0))).alias("positive_rate"))


def study_label_summary(cells: DataFrame, by: list[str], study: str, y: str = "y") -> DataFrame:
    """Studies, those without a labelled cell, evaluable ones, and labelled cells an evaluable study."""
    per = cells.groupBy(*by, study).agg(F.count(y).alias("n"))
    return per.groupBy(*by).agg(F.count("*").alias("studies"), count_if(F.col("n") == 0).alias("unlabelled"), count_if(F.col("n") > 0).alias("evaluable"), F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), DIGITS).alias("cells_each"))


def label_agreement(a: DataFrame, b: DataFrame, keys: list[str], target: str, y: str = "y") -> DataFrame:
    """By target, cells labelled in both sources, agreement, both kinds of disagreement, and one-sided cells."""
    both = a.select(*keys, F.col(y).alias("x")).join(b.select(*keys, F.col(y).alias("z")), keys)
    n = F.col("x").isNotNull() & F.col("z").isNotNull()
    return both.groupBy(target).agg(count_if(n).alias("both"), ratio(count_if(F.col("x") == F.col("z")), count_if(n)).alias("agreement"), count_if((F.col("x") == 1) & (F.col("z") == 0)).alias("pos_neg"), count_if((F.col("x") == 0) & (F.col("z") == 1)).alias("neg_pos"), count_if(F.col("x").isNotNull() & F.col("z").isNull()).alias("only_a"), count_if(F.col("x").isNull() & F.col("z").isNotNull()).alias("only_b"))


def decision_identity(a: DataFrame, b: DataFrame, keys: list[str], study: list[str], by: list[str] | None = None) -> DataFrame:
    """(by): the largest difference of probabilities, changed decisions, studies whose acceptance changed. Inputs have p, decision, accepted; keys and study hold by."""
    by = by or []
    both = a.select(*keys, F.struct("p", "decision", "accepted").alias("x")).join(b.select(*keys, F.struct("p", "decision", "accepted").alias("z")), keys)
    per = both.groupBy(*study).agg(F.max(F.abs(F.col("x.p") - F.col("z.p"))).alias("d"), F.count_if(F.col("x.decision") != F.col("z.decision")).alias("n"), F.bool_or(F.col("x.accepted") != F.col("z.accepted")).alias("c"))
    return per.groupBy(*by).agg(F.round(F.max("d"), DIGITS).alias("difference"), F.coalesce(F.sum("n"), F.lit(0)).alias("decisions"), count_if(F.col("c")).alias("acceptances"))


def category_positive_share(cells: DataFrame, target: str, raw: str, reference: str) -> DataFrame:
    """By target and label category, cells and the share that the expert calls positive."""
    return cells.groupBy(target, V.label_category(raw).alias("category")).agg(F.count("*").alias("cells"), F.round(F.avg(F.col(reference).cast("double")), DIGITS).alias("expert_positive"))


def wide(df: DataFrame, by: list[str], name: str, values: list[str], value: str) -> DataFrame:
    """Long results to one column a value of name; the values are given, so no extra pass finds them."""
    return df.groupBy(*by).pivot(name, values).agg(F.first(value, ignorenulls=True))


def run_segments(log: DataFrame, run_key: list[str], order: list[str], epoch: str, value: str, parts: int | None = None) -> DataFrame:
    """(run_key, run, epochs, best_epoch, best): a run begins where the epoch doesn't rise; the best epoch has the highest value (ties: the first).

    A segmented scan: the log is cut into parts by ranges of (run_key, order), so a long
    run_key is several tasks' work. A part's rows look back inside it, its first row to
    the last epoch of the part before; the runs that begin in a part are counted, and
    what earlier parts counted is carried over.
    """
    laid, _ = kept(ranged(log, run_key, [(c, False) for c in order], parts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "laid")
    inside = Window.partitionBy("_part", *run_key).orderBy(*(F.asc_nulls_first(c) for c in order))
    met = laid.groupBy("_part", *run_key).agg(F.max_by(F.struct(F.col(epoch)), F.struct(*order)).alias("_end"))
    before = met.select("_part", *run_key, F.lag("_end").over(Window.partitionBy(*run_key).orderBy("_part")).alias("_before"))
    same = ["_part", *run_key]
    joined = _null_safe(laid, before, same)
    last = F.when(F.row_number().over(inside) == 1, F.col(f"_before.{epoch}")).otherwise(F.lag(epoch).over(inside))
    opened, _ = kept(joined.withColumn("_last", last).withColumn("_new", F.when(F.col(epoch) > F.col("_last"), 0).otherwise(1)).drop("_before", "_last"), "opened")
    counted = opened.groupBy(*same).agg(F.sum("_new").alias("_runs"))
    earlier = Window.partitionBy(*run_key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counted.select(*same, F.coalesce(F.sum("_runs").over(earlier), F.lit(0)).alias("_carry"))
    local = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = _null_safe(opened.withColumn("_local", local), carried, same).withColumn("run", F.col("_local") + F.col("_carry"))
    best = F.max_by(F.struct(F.col(epoch).alias("e"), F.col(value).alias("v")), F.struct(value, -F.col(epoch)))
    return numbered.groupBy(*run_key, "run").agg(F.count("*").alias("epochs"), best.alias("b")).select(*run_key, "run", "epochs", F.col("b.e").alias("best_epoch"), F.col("b.v").alias("best"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys in which null equals null."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(named, same).drop(*(f"_r_{k}" for k in keys))
