"""Families of resampled estimates: levels, differences and extremes of items, with intervals.

An item is whatever the `by` columns say: a model and condition, a policy, a stratum, a
configuration. Studies' terms are summed by patient and item; one draw of a site serves
all its items. Points and draws are long tables (keys, measure, value), draws with rep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.functions import values as V
from cohortaudit.operators import policy as K
from cohortaudit.operators import resample as B
from cohortaudit.operators import risk as R
from cohortaudit.operators.audit import DIGITS, count_if
from cohortaudit.operators.prefix import ranged
from cohortaudit.sources.scratch import kept

MEASURES = ("coverage_all", "coverage_evaluable", *R.ESTIMATORS)


def measures(sums: DataFrame, keys: list[str], targets: list[str], names: tuple[str, ...] = MEASURES) -> DataFrame:
    """(keys, measure, value) of accepted and full sums; values are rounded so that equal ones are equal in whatever order they were summed."""
    part = lambda a, b: F.when(F.col(b) > 0, F.try_divide(a, b))
    found = {"coverage_all": part("a_one", "all_one"), "coverage_evaluable": part("a_evaluable", "all_evaluable")} | R.estimators(targets)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.round(found[k], 12).alias("value")) for k in names)))
    return sums.select(*keys, each.alias("m")).select(*keys, "m.*")


def items(terms: DataFrame, patients: DataFrame, by: list[str], targets: list[str], replicates: int, seed: str, names: tuple[str, ...] = MEASURES, site: str = "site", patient: str = "patient", accepted: str = "accepted") -> tuple[DataFrame, DataFrame]:
    """(points, draws): the measures of each site's items over all its patients and in each replicate."""
    columns = R.needed_sums(targets, names)
    per, _ = kept(R.accepted_sums(terms, [site, patient, *by], targets, accepted).select(site, patient, *by, *columns), "items")
    points = per.groupBy(site, *by).agg(*(F.sum(c).alias(c) for c in columns))
    draws = B.replicate_sums(per, patients, site, patient, by, columns, replicates, seed)
    return measures(points, [site, *by], targets, names), kept(measures(draws, ["rep", site, *by], targets, names), "draws")[0]


def difference(rows: DataFrame, axis: str, plus: str, minus: str) -> DataFrame:
    """Points or draws without the axis column: the value at plus less that at minus, null where either is missing."""
    keys = [c for c in rows.columns if c not in (axis, "value")]
    at = lambda v: F.max(F.when(F.col(axis) == v, F.col("value")))
    return rows.where(F.col(axis).isin(plus, minus)).groupBy(*keys).agg((at(plus) - at(minus)).alias("value"))


def estimates(points: DataFrame, draws: DataFrame, p: bool = False) -> DataFrame:
    """(keys, measure, value, low, high): points with 95 % percentile intervals; replicates without a value don't count. p adds the two-sided p value."""
    keys = [c for c in points.columns if c != "value"]
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    ci = draws.groupBy(*keys).agg(q.alias("q"), *([B.p_value("value").alias("p")] * p))
    rounded = [F.round(c, DIGITS).alias(k) for k, c in (("value", F.col("value")), ("low", F.col("q")[0]), ("high", F.col("q")[1]))]
    return points.join(ci, keys, "left").select(*keys, *rounded, *["p"] * p)


def extremes(rows: DataFrame, group: str) -> DataFrame:
    """Points or draws without the group column: the range of coverage over groups (measure `disparity`) and the highest value of each risk (measure `worst_...`)."""
    keys = [c for c in rows.columns if c not in (group, "value", "measure")]
    spread = rows.where("measure = 'coverage_all'").groupBy(*keys).agg(F.lit("disparity").alias("measure"), (F.max("value") - F.min("value")).alias("value"))
    worst = rows.where(~F.col("measure").startswith("coverage")).groupBy(*keys, F.concat(F.lit("worst_"), F.col("measure")).alias("measure")).agg(F.max("value").alias("value"))
    return spread.unionByName(worst.select(*spread.columns))


def worst_group(points: DataFrame, group: str) -> DataFrame:
    """(keys, measure, group): the group with the highest value (ties by name)."""
    keys = [c for c in points.columns if c not in (group, "value", "measure")]
    rows = points.where(~F.col("measure").startswith("coverage") & F.col("value").isNotNull())
    return rows.groupBy(*keys, F.concat(F.lit("worst_"), F.col("measure")).alias("measure")).agg(F.min_by(group, F.struct(-F.col("value"), F.col(group))).alias(group))


def policy_terms(rows: DataFrame, keys: list[str], model: str, target: str, fits: tuple[DataFrame, DataFrame], targets: list[str], y: str = "y") -> DataFrame:
    """(keys, policy, accepted, score, terms): the study terms of K.apply_policies(rows).

    keys name a study and all that goes with it. Its cells are aggregated once, under both
    kinds of decision, and only the study is copied for each policy.
    """
    known, cuts = fits
    cells, scores = K.judged(rows, model, target, known)
    wrong = F.coalesce(F.col("h1").cast("double") != F.col(y), F.lit(False))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    other = {"h_n_wrong": one(wrong)} | {f"h_wrong_{t}": one((F.col(target) == t) & wrong) for t in targets}
    studies = R.study_terms(cells, keys, targets, target, "d", y, scores | other).withColumns(K.study_scores()).join(F.broadcast(cuts), model)
    plain = {c: F.col(c) for c in R.term_columns(targets)}
    conformal = plain | {"n_wrong": F.col("h_n_wrong"), "e_orig": F.col("h_n_wrong") / F.greatest(F.col("n_obs"), F.lit(1.0))} | {f"wrong_{t}": F.col(f"h_wrong_{t}") for t in targets}
    each = F.array(*(F.struct(F.lit(n).alias("policy"), F.expr(a).alias("accepted"), F.col(s).alias("score"), *(c.alias(k) for k, c in (conformal if d == "h1" else plain).items())) for n, d, a, s in K.KINDS))
    return studies.select(*keys, F.explode(each).alias("_x")).select(*keys, "_x.*")


# weighted orders for all replicates at once -------------------------------------------
def _stacked(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["weights"].to_numpy()).astype(float) if len(rows) else np.zeros((0, 0))


def _over_parts(df: DataFrame, by: list[str], order: list[tuple[str, bool]], finish, ddl: str, parts: int | None = None) -> DataFrame:
    """finish(rows in order, weights, before, before_error, total) for each part of each group of df(by, order, error, weights).

    The order is laid once for all replicates: rows are dealt into parts by ranges of the
    whole key, a part's totals of weights and of weighted errors are summed by replicate,
    and what lies before each part is carried to it.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid, _ = kept(ranged(df, by, order, n), "laid")
    keys = ["_part", *by]

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False, dropna=False):
                w = _stacked(rows)
                made = np.stack((w.sum(axis=0), rows["error"].to_numpy(float) @ w))
                held[key] = held[key] + made if key in held else made
        for key, made in held.items():
            yield pd.DataFrame({**dict(zip(keys, key)), "_rep": np.arange(made.shape[1]), "_w": made[0], "_e": made[1]})

    kinds = ", ".join(f"`{c}` {laid.schema[c].dataType.simpleString()}" for c in keys)
    totals = laid.mapInPandas(total, f"{kinds}, _rep int, _w double, _e double").groupBy(*keys, "_rep").agg(F.sum("_w").alias("_w"), F.sum("_e").alias("_e"))
    group = Window.partitionBy(*by, "_rep")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, F.struct("_rep", F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("w"), F.coalesce(F.sum("_e").over(before), F.lit(0.0)).alias("e"), F.sum("_w").over(group).alias("all")).alias("_c"))
    carried = carried.groupBy(*keys).agg(F.array_sort(F.collect_list("_c")).alias("_c")).select(*keys, *(F.col(f"_c.{k}").alias(f"_{k}") for k in ("w", "e", "all")))

    def run(key, rows: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c, _ in order], ascending=[not down for _, down in order], kind="stable")
        made = finish(rows, _stacked(rows), *(np.asarray(carry[f"_{k}"].iloc[0]) for k in ("w", "e", "all")))
        return pd.DataFrame({**dict(zip(by, key[1:])), **made})

    return laid.groupBy(*keys).cogroup(carried.groupBy(*keys)).applyInPandas(run, ", ".join(kinds.split(", ")[1:]) + ", " + ddl)


def weighted_areas(df: DataFrame, by: list[str], confidence: str, error: str, key: str) -> DataFrame:
    """(by, rep, aurc, augrc) of rows with an array of weights, one for each replicate; rows without an error don't count."""
    rows = df.where(F.col(error).isNotNull()).select(*by, F.col(confidence).alias("_k"), key, F.col(error).cast("double").alias("error"), "weights")

    def finish(part, w, before, wrong, total):
        done = before + np.cumsum(w, axis=0)
        errors = wrong + np.cumsum(w * part["error"].to_numpy()[:, None], axis=0)
        risk = np.divide(errors, done, out=np.zeros_like(errors), where=done > 0)
        return {"rep": np.arange(len(total)), "_r": (w * risk).sum(axis=0), "_g": (w * errors).sum(axis=0), "_total": total}

    sums = _over_parts(rows, by, [("_k", True), (key, False)], finish, "rep int, _r double, _g double, _total double")
    return sums.groupBy(*by, "rep").agg(F.round(F.try_divide(F.sum("_r"), F.max("_total")), DIGITS).alias("aurc"), F.round(F.try_divide(F.sum("_g"), F.max("_total") * F.max("_total")), DIGITS).alias("augrc"))


def weighted_cutoffs(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by, rep, cutoff): the interpolated quantile of the values, each repeated by its weight in the replicate."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.lit(0.0).alias("error"), "weights")

    def finish(part, w, before, _, total):
        done, v = before + np.cumsum(w, axis=0), part["_v"].to_numpy()
        place = share * (total - 1)

        def at(k):
            inside = (before <= k) & (k < done[-1])
            return np.where(inside, v[np.minimum((done <= k).sum(axis=0), len(v) - 1)], np.nan)

        return {"rep": np.arange(len(total)), "_low": at(np.floor(place)), "_high": at(np.ceil(place)), "_rest": place - np.floor(place)}

    found = _over_parts(rows, by, [("_v", False)], finish, "rep int, _low double, _high double, _rest double")
    one = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    return found.groupBy(*by, "rep").agg(one("_low").alias("_a"), one("_high").alias("_b"), F.max("_rest").alias("_r")).select(*by, "rep", (F.col("_a") + F.col("_r") * (F.col("_b") - F.col("_a"))).alias("cutoff"))


def policy_replicates(cells: DataFrame, thresholds: DataFrame, cutoffs: DataFrame, targets: list[str], site: str = "site", model: str = "model", study: str = "study") -> DataFrame:
    """(rep, site, model, a_<term>, all_<term>): the sums of evaluation cells (site, model, study, target, p, y) under every replicate's policy.

    thresholds(rep, model, target, threshold) and cutoffs(rep, model, cutoff) have a row
    for each replicate, model and target; they go to every task, and cells meet them there.
    """
    known: dict[str, np.ndarray] = {}
    for m, rows in thresholds.toPandas().groupby(model):
        known[m] = rows.pivot(index="rep", columns="target", values="threshold").sort_index()[targets].to_numpy()
    cuts = {m: rows.sort_values("rep")["cutoff"].to_numpy() for m, rows in cutoffs.toPandas().groupby(model)}
    of = lambda c: [F.max(F.when(F.col("target") == t, F.col(c))).alias(f"{c}_{t}") for t in targets]
    wide = cells.groupBy(site, model, study).agg(*of("p"), *of("y"), F.min(V.confidence("p")).alias("confidence"))
    terms = R.term_columns(targets)
    at_fixed = [terms.index(c) for c in ("one", "evaluable", "n_obs", *(f"obs_{t}" for t in targets))]

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby([site, model], sort=False):
                p, y = (rows[[f"{c}_{t}" for t in targets]].to_numpy(float) for c in ("p", "y"))
                obs = ~np.isnan(y)
                n_obs = obs.sum(axis=1)
                accepted = rows["confidence"].to_numpy()[:, None] >= cuts[key[1]]
                # what no threshold changes is the same in every replicate but for who is accepted
                fixed = np.column_stack((np.ones(len(rows)), n_obs > 0, n_obs, obs)).astype(float)
                share = 1 / np.maximum(n_obs, 1)
                made = np.zeros((2, len(terms), accepted.shape[1]))
                made[0, at_fixed], made[1, at_fixed] = fixed.T @ accepted.astype(float), fixed.sum(axis=0)[:, None]
                for k, t in enumerate(targets):
                    wrong = ((p[:, k, None] >= known[key[1]][:, k]) != y[:, k, None]) & obs[:, k, None]
                    for a, counted in enumerate((wrong & accepted, wrong)):
                        n, e = np.stack((np.ones(len(rows)), share)) @ counted.astype(float)
                        made[a, terms.index("e_orig")] += e
                        made[a, terms.index("n_wrong")] += n
                        made[a, terms.index(f"wrong_{t}")] = n
                held[key] = held[key] + made if key in held else made
        for key, made in held.items():
            yield pd.DataFrame({"rep": np.arange(made.shape[2]), site: key[0], model: key[1], **{f"{a}_{c}": made[i, k] for i, a in enumerate(("a", "all")) for k, c in enumerate(terms)}})

    names = [f"{a}_{c}" for a in ("a", "all") for c in terms]
    sums = wide.mapInPandas(run, f"rep int, `{site}` string, `{model}` string, " + ", ".join(f"`{c}` double" for c in names))
    return sums.groupBy("rep", site, model).agg(*(F.sum(c).alias(c) for c in names))


def failure_detection(cells: DataFrame, keys: list[str], by: list[str], target: str = "target", p: str = "p", threshold: str = "threshold", decision: str = "decision", y: str = "y") -> DataFrame:
    """(by, level, target, score, n, error_share, auroc): how well two scores tell correct studies and cells from wrong ones.

    The scores are |2p - 1| and the margin to the threshold; a study's are its least over
    targets, and it is wrong if any labelled cell is. keys name a study.
    """
    margin = V.threshold_margin(p, threshold)
    scored = cells.withColumns({"_confidence": V.confidence(p), "_margin": margin, "_wrong": F.when(F.col(y).isNotNull(), F.col(decision).cast("double") != F.col(y))})
    own = [c for c in by if c not in keys]
    study = scored.groupBy(*keys, *own).agg(F.min("_confidence").alias("confidence"), F.min("_margin").alias("margin"), F.bool_or("_wrong").alias("wrong")).select(*by, F.lit("study").alias("level"), F.lit("all").alias("target"), "confidence", "margin", "wrong")
    cell = scored.select(*by, F.lit("cell").alias("level"), F.col(target).alias("target"), F.col("_confidence").alias("confidence"), F.col("_margin").alias("margin"), F.col("_wrong").alias("wrong"))
    both = study.unionByName(cell).where("wrong is not null")
    each = F.explode(F.array(F.struct(F.lit("confidence").alias("score"), F.col("confidence").alias("s")), F.struct(F.lit("margin").alias("score"), F.col("margin").alias("s"))))
    long = both.select(*by, "level", "target", "wrong", each.alias("x")).select(*by, "level", "target", "wrong", "x.*")
    group = [*by, "level", "target", "score"]
    counted = long.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.avg(F.col("wrong").cast("double")), DIGITS).alias("error_share"))
    return counted.join(R.auroc(long, group, "s", ~F.col("wrong")).select(*group, "auroc"), group)


def swapped_passes(swaps: DataFrame, predictions: DataFrame, study: str, donor: str, change: Column) -> DataFrame:
    """Predictions under each swap(seed, study, donor): `change` gives the new p from p and the donor's columns."""
    return predictions.join(swaps.select("seed", F.col(study).alias(study), F.col(donor).alias("donor")), study).withColumn("p", change)


def described(cells: DataFrame, by: list[str], study: str, y: str = "y") -> DataFrame:
    """(by, studies, evaluable, evaluable_share, density, positive_rate) of labels."""
    per = cells.groupBy(*by, study).agg(F.count(y).alias("n"), F.sum(y).alias("pos"), F.count("*").alias("cells"))
    got = per.groupBy(*by).agg(F.count("*").alias("studies"), count_if(F.col("n") > 0).alias("evaluable"), F.sum("n").alias("n"), F.sum("cells").alias("cells"), F.sum("pos").alias("pos"))
    r = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), DIGITS)
    return got.select(*by, "studies", "evaluable", r("evaluable", "studies").alias("evaluable_share"), r("n", "cells").alias("density"), r("pos", "n").alias("positive_rate"))
