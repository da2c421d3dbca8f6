"""Eligible cohorts, patient partitions, stratified samples and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.operators.audit import DIGITS, count_if, ratio
from cohortaudit.operators.prefix import positions


def waterfall(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, before, removed, after, fraction) of filters that follow on each other; a null condition fails.

    One pass: each row is counted at the first step that it fails.
    """
    first = F.lit(len(steps) + 1)
    for i, (_, keep) in reversed(list(enumerate(steps, 1))):
        first = F.when(~F.coalesce(keep, F.lit(False)), i).otherwise(first)
    counts = df.groupBy(first.alias("step")).agg(F.count("*").alias("removed"))
    names = df.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(steps, 1)], "step int, name string")
    every = names.join(F.broadcast(counts), "step", "left")
    total = df.agg(F.count("*").alias("total"))
    # a row for each step
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = every.join(F.broadcast(total)).withColumn("removed", F.coalesce("removed", F.lit(0))).withColumn("before", F.col("total") - F.coalesce(F.sum("removed").over(upto), F.lit(0)))
    return rows.select("step", "name", "before", "removed", (F.col("before") - F.col("removed")).alias("after"), ratio(F.col("before") - F.col("removed"), F.col("total")).alias("fraction"))


def eligible(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """The rows that pass every step."""
    return df.where(reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for _, c in steps)))


def hashed_order(seed: str, key: str) -> tuple[Column, Column]:
    """A reproducible random order of keys: by md5 of seed:key, then by the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)


def choose(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n distinct keys in hashed order; an ordered limit, so no task sees more than n beyond its own."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(*hashed_order(seed, key)).limit(n)


def assign_tiers(df: DataFrame, patient: str, split: str, pool: str, evaluation: int, calibration: int, seed: str) -> DataFrame:
    """Df with tier: of the pool split's patients the first `evaluation` in hashed order, then `calibration`, rest train; other splits official_<split>."""
    picked = choose(df.where(F.col(split) == pool), patient, evaluation + calibration, seed)
    order = Window.orderBy(*hashed_order(seed, patient))
    # the window sees the chosen patients alone, a number fixed by the two sizes
    ranked = picked.withColumn("_n", F.row_number().over(order))
    tier = F.when(F.col(split) != pool, F.concat(F.lit("official_"), F.col(split))).when(F.col("_n") <= evaluation, "eval").when(F.col("_n").isNotNull(), "calibration").otherwise("train")
    return df.join(ranked, patient, "left").withColumn("tier", tier).drop("_n")


def split_validation(df: DataFrame, patient: str, fraction: float, seed: str) -> DataFrame:
    """Df with part `validation` for max(1, round(fraction * patients)) patients, else `train`."""
    n = max(1, round(fraction * df.select(patient).distinct().count()))
    chosen = choose(df, patient, n, seed).withColumn("part", F.lit("validation"))
    return df.join(chosen, patient, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def tier_summary(df: DataFrame, tier: str, patient: str, study: str) -> DataFrame:
    """Patients, studies and rows by tier."""
    return df.groupBy(tier).agg(F.count_distinct(patient).alias("patients"), F.count_distinct(study).alias("studies"), F.count("*").alias("rows"))


def tier_disjoint(df: DataFrame, tier: str, patient: str) -> DataFrame:
    """One row: patients in several tiers and whether there are none."""
    n = df.groupBy(patient).agg(F.count_distinct(tier).alias("n"))
    return n.agg(count_if(F.col("n") > 1).alias("shared"), (count_if(F.col("n") > 1) == 0).alias("disjoint"))


def budgets(df: DataFrame, patient: str, sizes: list[int], seed: str) -> DataFrame:
    """Studies and patients of nested budgets: the first patients in hashed order.

    Only the largest budget's patients are ranked.
    """
    picked = choose(df, patient, max(sizes), seed).withColumn("rank", F.row_number().over(Window.orderBy(*hashed_order(seed, patient))))
    per = df.join(picked, patient).groupBy(patient, "rank").agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(b,) for b in sizes], "budget int")
    return per.join(F.broadcast(grid), F.col("rank") <= F.col("budget")).groupBy("budget").agg(F.count("*").alias("patients"), F.sum("n").alias("studies"))


def view_distribution(images: DataFrame, view: str, study: str) -> DataFrame:
    """Images and studies by view."""
    return images.groupBy(view).agg(F.count("*").alias("images"), F.count_distinct(study).alias("studies"))


def split_sensitivity(df: DataFrame, split: str, patient: str, tokens: str, thresholds: list[int]) -> DataFrame:
    """Rows and patients by split, and how many keep at least T tokens for each T."""
    keep = lambda t: F.col(tokens) >= t
    return df.groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(patient).alias("patients"), *(c for t in thresholds for c in (count_if(keep(t)).alias(f"rows_{t}"), F.count_distinct(F.when(keep(t), F.col(patient))).alias(f"patients_{t}"))))


def stratum_code(label: str, abstained: str, context: str) -> tuple[Column, Column]:
    """C4: the code L?A?P? of three flags, and its group: disagree (L1), abstain (A1 of the rest), other."""
    bit = lambda c: F.when(F.col(c), "1").otherwise("0")
    code = F.concat(F.lit("L"), bit(label), F.lit("A"), bit(abstained), F.lit("P"), bit(context))
    return code, F.when(F.col(label), "disagree").when(F.col(abstained), "abstain").otherwise("other")


def proportional(sizes: dict[str, int], n: int) -> dict[str, int]:
    """N shared by size with largest remainders, never more than a size; what is cut is shared anew.

    Of equal remainders the larger stratum, then the later name, comes first.
    """
    out = dict.fromkeys(sizes, 0)
    left = min(n, sum(sizes.values()))
    while left:
        room = {k: v - out[k] for k, v in sizes.items() if v > out[k]}
        total = sum(sizes[k] for k in room)
        ideal = {k: left * sizes[k] / total for k in room}
        give = {k: min(int(ideal[k]), room[k]) for k in room}
        rest = left - sum(int(x) for x in ideal.values())
        for k in sorted(room, key=lambda k: (ideal[k] - int(ideal[k]), sizes[k], k), reverse=True)[:rest]:
            give[k] = min(give[k] + 1, room[k])
        for k, g in give.items():
            out[k] += g
        left -= sum(give.values())
    return out


def allocate(counts: DataFrame, n: int, shares: dict[str, float]) -> dict[str, int]:
    """A sample size for each stratum from (stratum, group, n): groups get their shares of n, strata of a group in proportion.

    counts has a row for each stratum, tens of them; only they come to the driver.
    """
    rows = [(r.stratum, r.group, r.n) for r in counts.orderBy("stratum").collect()]
    out: dict[str, int] = {}
    for group, share in shares.items():
        out |= proportional({s: k for s, g, k in rows if g == group}, round(n * share))
    return out


def draw(df: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """`sizes` rows of each stratum in hashed order, with probability, the stratum's share drawn."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(s, n) for s, n in sizes.items()], f"{stratum} string, _want int")
    totals = df.groupBy(stratum).agg(F.count("*").alias("_all"))
    ranked = df.join(F.broadcast(wanted), stratum).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(*hashed_order(seed, key))))
    # the literal bound lets each task keep only that many rows of a stratum
    ranked = ranked.where(F.col("_n") <= max(sizes.values(), default=0)).where("_n <= _want")
    return ranked.join(F.broadcast(totals), stratum).withColumn("probability", F.round(F.col("_want") / F.col("_all"), DIGITS)).drop("_n", "_want", "_all")


def reading_order(items: DataFrame, readers: list[str], item: str, practice: str, seed: str) -> DataFrame:
    """(reader, item, position): each reader's own order, practice items first."""
    who = items.sparkSession.createDataFrame([(r,) for r in readers], "reader string")
    key = F.concat(F.when(F.col(practice), "0").otherwise("1"), F.md5(F.concat_ws(":", F.lit(seed), "reader", F.col(item).cast("string"))))
    rows = items.join(F.broadcast(who)).withColumn("_key", key)  # a few readers
    return positions(rows, ["reader"], ["_key", item]).select("reader", item, (F.col("position") + 1).alias("position"))


def download_list(df: DataFrame, tier: str, path: str) -> DataFrame:
    """Distinct (tier, path), in order."""
    return df.select(tier, path).where(F.col(path).isNotNull()).distinct().orderBy(tier, path)


def design_effect(df: DataFrame, by: str, patient: str, coverage: float, icc: float) -> DataFrame:
    """N, m_adj = sum(m * m) / sum(m) and 1 + (m_adj - 1) * icc by group, with cluster sizes thinned by coverage."""
    m = df.groupBy(by, patient).agg((F.count("*") * F.lit(coverage)).alias("m"))
    adjusted = F.try_divide(F.sum(F.col("m") * F.col("m")), F.sum("m"))
    return m.groupBy(by).agg(F.round(F.sum("m"), DIGITS).alias("n"), F.round(adjusted, DIGITS).alias("m_adj"), F.round(1 + (F.greatest(adjusted, F.lit(1.0)) - 1) * icc, DIGITS).alias("deff"))


def detectable(design: DataFrame, sds: list[float], z: float = 2.801585) -> DataFrame:
    """Standard errors of a mean and of a paired difference, and the least detectable effect, by group and sd.

    z is the sum of the normal quantiles of 0.975 and 0.8; a paired difference has half the variance of two means.
    """
    grid = design.sparkSession.createDataFrame([(s,) for s in sds], "sd double")
    rows = design.join(F.broadcast(grid))
    se = F.col("sd") * F.sqrt(F.try_divide(F.col("deff"), F.col("n")))
    return rows.select(design.columns[0], "sd", F.round(se, DIGITS).alias("se_paired"), F.round(se * F.sqrt(F.lit(2.0)), DIGITS).alias("se_unpaired"), F.round(se * z, DIGITS).alias("mde"))


def distinct_states(df: DataFrame, state: str, study: str) -> DataFrame:
    """Distinct studies by natural state."""
    return df.groupBy(state).agg(F.count_distinct(study).alias("studies"))


