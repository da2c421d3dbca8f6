"""Thresholds and abstention cutoffs, fitted on one site and frozen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.functions import values as V
from cohortaudit.operators.audit import DIGITS, count_if
from cohortaudit.operators.prefix import quantiles, running_sums, with_totals
from cohortaudit.sources.scratch import kept

GRID = 1000


def _grid_bin(p: Column) -> Column:
    """How many of 1/1000 ... 999/1000 are at most p, by the same double division."""
    b = F.floor(p * GRID).cast("int")
    up = F.when((b + 1) / F.lit(float(GRID)) <= p, b + 1).otherwise(b)
    return F.least(F.when(up / F.lit(float(GRID)) > p, up - 1).otherwise(up), F.lit(GRID - 1))


def grid_histogram(df: DataFrame, by: list[str], p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """(by, bin, pos, neg): labelled rows counted in 1,000 bins of p."""
    w = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(y).isNotNull()).select(*by, _grid_bin(F.col(p)).alias("bin"), (w * F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), (w * F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    return rows.groupBy(*by, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def best_on_grid(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, balanced_accuracy) of histograms: the grid meets only the counts."""
    totals = hist.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(GRID - 1))))
    full = grid.join(hist, [*by, "bin"], "left")
    above = Window.partitionBy(*by).orderBy(F.desc("bin"))  # 999 rows a group
    got = full.withColumns({"tp": F.sum(F.coalesce("pos", F.lit(0))).over(above), "fp": F.sum(F.coalesce("neg", F.lit(0))).over(above)})
    part = lambda a, n: F.when(F.col(n) > 0, F.try_divide(a.cast("double"), F.col(n)))
    score = (part(F.col("tp"), "all_pos") + part(F.col("all_neg") - F.col("fp"), "all_neg")) / 2
    best = got.withColumn("s", score).groupBy(*by).agg(F.max("s").alias("balanced_accuracy"), F.min_by("bin", F.struct(-F.col("s"), "bin")).alias("bin"))
    return best.select(*by, F.when(F.col("balanced_accuracy").isNull(), 0.5).otherwise(F.col("bin") / F.lit(float(GRID))).alias("threshold"), F.round("balanced_accuracy", DIGITS).alias("balanced_accuracy"))


def grid_thresholds(df: DataFrame, by: list[str], p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """(by, threshold, balanced_accuracy): the first grid threshold of the highest balanced accuracy.

    Only rows with a label count. With one class the threshold is 0.5 and the accuracy
    null. Rows are counted in 1,000 bins; the grid meets only the counts.
    """
    return best_on_grid(grid_histogram(df, by, p, y, weight), by)


def exact_thresholds(df: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """K2: as K1 over the candidates 0, every value of p, and one above 1; ties go to the nearest to 0.5, then the smaller."""
    rows = df.where(F.col(y).isNotNull())
    hist = rows.groupBy(*by, F.col(p).alias("_t")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    ends = hist.select(*by).distinct().withColumn("_t", F.explode(F.array(F.lit(0.0), F.lit(math.nextafter(1.0, 2.0))))).withColumns({"pos": F.lit(0).cast("long"), "neg": F.lit(0).cast("long")})
    every = hist.unionByName(ends).groupBy(*by, "_t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    run = running_sums(every, by, [("_t", True)], ["pos", "neg"])
    got = with_totals(run, every, by, {"all_pos": "pos", "all_neg": "neg"})
    score = (F.try_divide(F.col("cum_pos").cast("double"), F.col("all_pos")) + F.try_divide((F.col("all_neg") - F.col("cum_neg")).cast("double"), F.col("all_neg"))) / 2
    best = got.withColumn("_s", score).groupBy(*by).agg(F.max("_s").alias("balanced_accuracy"), F.min_by("_t", F.struct(-F.col("_s"), F.abs(F.col("_t") - 0.5), "_t")).alias("_b"))
    return best.select(*by, F.when(F.col("balanced_accuracy").isNull(), 0.5).otherwise(F.col("_b")).alias("threshold"), F.round("balanced_accuracy", DIGITS).alias("balanced_accuracy"))


def study_confidence(df: DataFrame, keys: list[str], mode: str = "min", p: str = "p") -> DataFrame:
    """(keys, confidence): the least or the mean over targets of |2p - 1|."""
    if mode not in ("min", "mean"):
        raise ValueError(f"no such mode: {mode}")
    c = V.confidence(p)
    return df.groupBy(*keys).agg((F.min(c) if mode == "min" else F.avg(c)).alias("confidence"))


def cutoffs(confidences: DataFrame, by: list[str], coverages: list[float]) -> DataFrame:
    """(by, coverage, cutoff): the linear-interpolated quantile of confidence at 1 - coverage."""
    got = quantiles(confidences, by, "confidence", [1 - c for c in coverages])
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, coverages)).alias("coverage"), F.col("q").alias("cutoff")))
    return got.select(*by, pairs.alias("c")).select(*by, "c.coverage", "c.cutoff")


def rank_cutoffs(confidences: DataFrame, by: list[str], coverage: float) -> DataFrame:
    """(by, cutoff): the confidence at rank ceil(coverage * n) from above."""
    # distinct values with counts, so the order is over values and not over studies
    counts = confidences.groupBy(*by, "confidence").agg(F.count("*").alias("n"))
    run = with_totals(running_sums(counts, by, [("confidence", True)], ["n"]), counts, by, {"total": "n"})
    return run.where(F.col("cum_n") >= F.ceil(F.col("total") * coverage)).groupBy(*by).agg(F.max("confidence").alias("cutoff"))


def conformal_quantile(df: DataFrame, by: list[str], alpha: float, p: str = "p", y: str = "y") -> DataFrame:
    """(by, q): the k-th smallest 1 - p of the true class, k = ceil((n + 1)(1 - alpha)); 1 if k > n."""
    s = F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p))
    counts = df.where(F.col(y).isNotNull()).select(*by, s.alias("s")).groupBy(*by, "s").agg(F.count("*").alias("n"))
    run = with_totals(running_sums(counts, by, [("s", False)], ["n"]), counts, by, {"total": "n"})
    k = F.ceil((F.col("total") + 1) * F.lit(1 - alpha))
    return run.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("cum_n") >= k, F.col("s"))), F.lit(1.0)).alias("q"))


def conformal_fit(cal: DataFrame, by: list[str], target: str, study: str, alphas: list[float], coverage: float = 0.8, p: str = "p", y: str = "y") -> DataFrame:
    """K8: (by, target, alpha, acceptance, q): the alpha of conformal_search() and each target's quantile at it.

    A counted score answers the alphas whose rank falls on it, so no row is copied for
    an alpha that it doesn't answer.
    """
    s = F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p))
    counts = cal.where(F.col(y).isNotNull()).select(*by, target, s.alias("s")).groupBy(*by, target, "s").agg(F.count("*").alias("n"))
    run = with_totals(running_sums(counts, [*by, target], [("s", False)], ["n"]), counts, [*by, target], {"total": "n"})
    grid = F.array(*map(F.lit, alphas))
    rank = lambda a: F.ceil((F.col("total") + 1) * (1 - a))
    answered = run.select(*by, target, "s", F.explode(F.filter(grid, lambda a: (rank(a) > F.col("cum_n") - F.col("n")) & (rank(a) <= F.col("cum_n")))).alias("alpha"))
    every = counts.select(*by, target).distinct().withColumn("alpha", F.explode(grid))
    q, _ = kept(every.join(answered, [*by, target, "alpha"], "left").select(*by, target, "alpha", F.coalesce("s", F.lit(1.0)).alias("q")), "quantiles")
    # Quantiles fall as alphas rise, so a cell has a single label from the first alpha whose
    # quantile is below its larger side on, as long as the quantile reaches its smaller side.
    # A study's alphas are the range that its cells share; ranges are counted and summed up.
    known = q.groupBy(*by, target).agg(F.array_sort(F.collect_list(F.struct("alpha", "q"))).alias("_q")).select(*by, target, F.col("_q.q").alias("_q"))
    cells = cal.select(*by, target, study, F.col(p).alias("_p")).join(F.broadcast(known), [*by, target])
    reached = lambda side: F.size(F.filter("_q", lambda v: v >= side))
    own = cells.groupBy(*by, study).agg(F.max(reached(F.greatest("_p", 1 - F.col("_p")))).alias("_a"), F.min(reached(F.least("_p", 1 - F.col("_p")))).alias("_b"))
    ranges = own.groupBy(*by, "_a", "_b").agg(F.count("*").alias("_n"))
    inside = F.when(F.col("_a") < F.col("_b"), F.col("_n")).otherwise(0)
    ends = F.explode(F.array(F.struct(F.col("_a").alias("_k"), inside.alias("_n")), F.struct(F.col("_b").alias("_k"), (-inside).alias("_n"))))
    counted, _ = kept(ranges.select(*by, "_n", ends.alias("_e")).groupBy(*by, "_e._k").agg(F.sum("_e._n").alias("_more"), F.sum("_n").alias("_ends")), "ranges")
    every = counted.groupBy(*by).agg((F.sum("_ends") / 2).alias("_all")).select(*by, "_all", F.posexplode(F.array_sort(grid)).alias("_k", "alpha"))  # a study has two ends
    upto = Window.partitionBy(*by).orderBy("_k")  # a row for each alpha
    rate = every.join(counted, [*by, "_k"], "left").select(*by, "alpha", (F.sum(F.coalesce("_more", F.lit(0))).over(upto) / F.col("_all")).alias("acceptance"))
    best = F.min_by(F.struct("alpha", "acceptance"), F.struct(F.round(F.abs(F.col("acceptance") - coverage), 9), "alpha"))
    chosen = rate.groupBy(*by).agg(best.alias("b")).select(*by, "b.alpha", F.round("b.acceptance", DIGITS).alias("acceptance"))
    return q.join(F.broadcast(chosen), [*by, "alpha"]).select(*by, target, "alpha", "acceptance", "q")


def conformal_search(cal: DataFrame, by: list[str], target: str, study: str, alphas: list[float], coverage: float = 0.8, p: str = "p", y: str = "y") -> DataFrame:
    """K8: (by, alpha, acceptance): the alpha whose share of studies with a single label in every target is nearest to coverage; ties to the smaller.

    Every alpha's quantiles come from one pass over counted scores.
    """
    return conformal_fit(cal, by, target, study, alphas, coverage, p, y).select(*by, "alpha", "acceptance").distinct()


#: Newton's steps at most, and the step at which a fit counts as done.
STEPS, DONE = 50, 1e-12


def fit_scaling(df: DataFrame, by: list[str], intercept: bool, p: str = "p", y: str = "y") -> DataFrame:
    """K5, K6: (by, a, b) of y ~ sigmoid(a * logit(p) + b); without intercept b is 0 and the temperature is 1 / a.

    All groups are fitted together by Newton's method, one aggregation a step over the
    counts of each p; only a row for each group comes to the driver. A slope that isn't
    positive, or a fit that doesn't settle, gives null (no temperature).
    """
    spark = df.sparkSession
    one = F.when(F.col(y) == 1, 1).otherwise(0)
    counts = df.where(F.col(y).isNotNull()).groupBy(*by, V.logit(p).alias("_x")).agg(F.sum(one).alias("_pos"), F.count("*").alias("_n")).cache()
    fits = {tuple(r[c] for c in by): [1.0, 0.0, None] for r in counts.select(*by).distinct().collect()}
    schema = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in by)
    for _ in range(STEPS):
        now = spark.createDataFrame([(*k, a, b) for k, (a, b, _) in fits.items()], f"{schema}, _a double, _b double")
        s = 1 / (1 + F.exp(-(F.col("_a") * F.col("_x") + F.col("_b"))))
        left, w = F.col("_pos") - F.col("_n") * s, F.col("_n") * s * (1 - s)
        sums = {"ga": left * F.col("_x"), "gb": left, "haa": w * F.col("_x") * F.col("_x"), "hab": w * F.col("_x"), "hbb": w}
        for r in counts.join(F.broadcast(now), by).groupBy(*by).agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect():
            fit = fits[tuple(r[c] for c in by)]
            det = r.haa * r.hbb - r.hab * r.hab if intercept else r.haa
            if not det > 0 or not math.isfinite(det):
                fit[2] = None
                continue
            step = ((r.hbb * r.ga - r.hab * r.gb) / det, (r.haa * r.gb - r.hab * r.ga) / det) if intercept else (r.ga / det, 0.0)
            fit[0], fit[1], fit[2] = fit[0] + step[0], fit[1] + step[1], max(map(abs, step))
        if all(size is None or size < DONE for _, _, size in fits.values()):
            break
    counts.unpersist()
    sound = lambda a, size: size is not None and size < 1e-6 and a > 0
    return spark.createDataFrame([(*k, a if sound(a, size) else None, b if sound(a, size) else None) for k, (a, b, size) in fits.items()], f"{schema}, a double, b double")


def expected_loss(df: DataFrame, fits: DataFrame, thresholds: DataFrame, keys: list[str], by: list[str], p: str = "p") -> DataFrame:
    """K7: (keys, score): minus the mean chance of error over targets, with calibrated probabilities and frozen decisions. fits and thresholds have a row for each `by`."""
    rows = df.join(F.broadcast(fits.select(*by, "a", "b")), by).join(F.broadcast(thresholds.select(*by, "threshold")), by)
    q = 1 / (1 + F.exp(-(F.col("a") * V.logit(p) + F.col("b"))))
    wrong = F.when(F.col(p) >= F.col("threshold"), 1 - q).otherwise(q)
    return rows.groupBy(*keys).agg((-F.avg(wrong)).alias("score"))


def policies(cells: DataFrame, model: str, study: str, target: str, thresholds: DataFrame, temperatures: DataFrame, quantiles: DataFrame, losses: DataFrame, cuts: DataFrame) -> DataFrame:
    """K9: (policy, model, study, target, decision, accepted, score) of five policies: frozen, temp_margin, expected_loss, conformal, conformal_frozen.

    thresholds, temperatures (a) and quantiles (q) have a row for each model and target,
    losses (score) for each model and study, cuts (plain, cold, loss) for each model.
    """
    by, of_study = [model, target], Window.partitionBy(model, study)
    rows = cells.join(F.broadcast(thresholds.select(*by, "threshold")), by).join(F.broadcast(temperatures.select(*by, F.col("a").alias("_a"))), by)
    rows = rows.join(F.broadcast(quantiles), by).join(F.broadcast(cuts), model).join(losses, [model, study])
    cold = 1 / (1 + F.exp(-F.col("_a") * V.logit("p")))
    has1, has0 = (1 - F.col("p")) <= F.col("q"), F.col("p") <= F.col("q")
    rows = rows.withColumns({
        "d": F.col("p") >= F.col("threshold"), "c": F.min(V.confidence("p")).over(of_study), "ct": F.min(F.abs(2 * cold - 1)).over(of_study), "all_single": F.min(F.when(has1 != has0, 1).otherwise(0)).over(of_study) == 1, "h1": has1,
    })
    kinds = [
        ("frozen", F.col("d"), F.col("c") >= F.col("plain"), F.col("c")), ("temp_margin", F.col("d"), F.col("ct") >= F.col("cold"), F.col("ct")), ("expected_loss", F.col("d"), F.col("score") >= F.col("loss"), F.col("score")),
        ("conformal", F.col("h1"), F.col("all_single"), F.col("c")), ("conformal_frozen", F.col("d"), F.col("all_single"), F.col("c")),
    ]
    every = F.array(*(F.struct(F.lit(n).alias("policy"), d.alias("decision"), a.alias("accepted"), s.alias("score")) for n, d, a, s in kinds))
    return rows.select(model, study, target, F.explode(every).alias("x")).select("x.policy", model, study, target, "x.decision", "x.accepted", "x.score")


def fit_policies(cal: DataFrame, model: str, study: str, target: str, alphas: list[float], coverage: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """K9: (cells, cuts): what the five policies need, fitted on calibration rows: threshold, cold, a, b, q by model and target; plain, chill, loss by model."""
    by = [model, target]
    cal, _ = kept(cal.select(model, study, target, "p", "y"), "calibration")
    thresholds, fits = grid_thresholds(cal, by).select(*by, "threshold"), fit_scaling(cal, by, True)
    cold = fit_scaling(cal, by, False).select(*by, F.col("a").alias("cold"))
    q = conformal_fit(cal, [model], target, study, alphas, coverage).select(*by, "q")
    cells, _ = kept(thresholds.join(cold, by).join(fits, by).join(q, by), "fits")
    scores = _scored(cal, [model, study], model, target, cells).select(model, study, "c", "ct", "el").distinct()
    cut = lambda c, name: cutoffs(scores.select(model, study, F.col(c).alias("confidence")), [model], [coverage]).select(model, F.col("cutoff").alias(name))
    cuts, _ = kept(cut("c", "plain").join(cut("ct", "chill"), model).join(cut("el", "loss"), model), "cuts")
    return cells, cuts


def judged(rows: DataFrame, model: str, target: str, fits: DataFrame, p: str = "p") -> tuple[DataFrame, dict[str, Column]]:
    """rows with each cell's decisions d and h1, and the aggregates that make a study's scores of its cells."""
    known = rows.join(F.broadcast(fits), [model, target])
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    has1, has0 = (1 - F.col(p)) <= F.col("q"), F.col(p) <= F.col("q")
    chance, d = sigmoid(F.col("a") * V.logit(p) + F.col("b")), F.col("d")
    return known.withColumns({"d": F.col(p) >= F.col("threshold"), "h1": has1}), {
        "c": F.min(V.confidence(p)), "ct": F.min(F.abs(2 * sigmoid(F.col("cold") * V.logit(p)) - 1)), "el": F.avg(F.when(d, 1 - chance).otherwise(chance)),
        "single": F.min(F.when(has1 != has0, 1).otherwise(0)), "cs": F.min(F.abs(F.col(p) - 0.5) - F.abs(F.col("q") - 0.5)),
    }


def study_scores() -> dict[str, Column]:
    """A study's scores from the aggregates of judged, rounded, so that a study at a cutoff is on the same side of it on every machine."""
    return {"ct": F.round("ct", 12), "el": F.round(-F.col("el"), 12), "single": F.col("single") == 1, "cs": F.round("cs", 12)}


def _scored(rows: DataFrame, keys: list[str], model: str, target: str, fits: DataFrame, p: str = "p") -> DataFrame:
    """rows with each cell's decisions and each study's scores; keys name a study."""
    of_study = Window.partitionBy(*keys)
    cells, found = judged(rows, model, target, fits, p)
    return cells.withColumns({k: c.over(of_study) for k, c in found.items()}).withColumns(study_scores())


#: The policies: (name, the cells' decision, whether a study is accepted, its score).
KINDS = [("frozen", "d", "c >= plain", "c"), ("temp_margin", "d", "ct >= chill", "ct"), ("expected_loss", "d", "el >= loss", "el"), ("conformal", "h1", "single", "cs"), ("conformal_frozen", "d", "single", "cs")]


def apply_policies(rows: DataFrame, keys: list[str], model: str, target: str, fits: tuple[DataFrame, DataFrame], p: str = "p") -> DataFrame:
    """Rows once for each of the five policies, with policy, decision, accepted and score; keys name a study."""
    cells, cuts = fits
    scored = _scored(rows, keys, model, target, cells, p).join(F.broadcast(cuts), model)
    every = F.array(*(F.struct(F.lit(n).alias("policy"), F.col(d).alias("decision"), F.expr(a).alias("accepted"), F.col(s).alias("score")) for n, d, a, s in KINDS))
    return scored.select(*rows.columns, F.explode(every).alias("_x")).select(*rows.columns, "_x.*")


def replay_check(fitted: DataFrame, stored: DataFrame, by: list[str], column: str, within: float) -> DataFrame:
    """One row: settings compared, missing on either side, the largest difference, and whether all is within."""
    both = fitted.select(*by, F.col(column).alias("x")).join(stored.select(*by, F.col(column).alias("z")), by, "full_outer")
    d = F.abs(F.col("x") - F.col("z"))
    lost = count_if(F.col("x").isNull() | F.col("z").isNull())
    return both.agg(F.count("*").alias("compared"), lost.alias("missing"), F.round(F.max(d), 9).alias("difference"), ((lost == 0) & (F.max(d) <= within)).alias("same"))


def calibration_uncertainty(gaps: DataFrame, points: DataFrame, settings: DataFrame, by: list[str], model: str) -> DataFrame:
    """(model, by, replicates, point, mean, sd, low, high, cutoff_sd, threshold_sd_<target>): how gaps move when policies are refitted.

    gaps(rep, model, by, value) are those under each replicate's policy, points(model, by,
    value) under the frozen one; settings(rep, model, setting, value) are the refitted
    `cutoff` and thresholds. sds divide by n - 1.
    """
    r, keys = lambda c: F.round(c, DIGITS), [model, *by]
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    moved = gaps.groupBy(*keys).agg(F.count("value").alias("replicates"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("sd"), q.alias("q"))
    spread = settings.groupBy(model, "setting").agg(r(F.stddev_samp("value")).alias("sd"))
    names = sorted(x.setting for x in spread.select("setting").distinct().collect())  # cutoff and targets
    wide = spread.groupBy(model).agg(*(F.max(F.when(F.col("setting") == n, F.col("sd"))).alias("cutoff_sd" if n == "cutoff" else f"threshold_sd_{n}") for n in names))
    frozen = points.select(*keys, r(F.col("value")).alias("point"))
    return moved.join(frozen, keys).join(wide, model).select(*keys, "replicates", "point", "mean", "sd", r(F.col("q")[0]).alias("low"), r(F.col("q")[1]).alias("high"), *(c for c in wide.columns if c != model))
