"""Patient-clustered bootstrap, intervals, p values, contrasts and verdicts.

Draws come from the count tree of draws.py, so they are the same for every condition of
a site, independent between sites, and made where the patients lie. Sums are taken by
patient first; a task weighs the sums of its patients for all replicates at once, and
only the replicates' sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.operators import draws as D
from cohortaudit.operators.audit import DIGITS
from cohortaudit.operators.prefix import positions
from cohortaudit.sources.scratch import kept

# The registered rules: direction and materiality of each hypothesis.
RULES = {"H1": ("greater", 0.02), "H2": ("greater", 0.02), "H3": ("greater", 0.02), "H4": ("greater_or_equal", None)}
SHORT = {
    "confirmed": "confirmed",
    "same_direction_not_material": "same direction, below materiality",
    "inconclusive": "inconclusive (CI includes 0)",
    "opposite_direction_not_material": "opposite direction, below materiality",
    "opposite_direction_material": "opposite direction, material magnitude",
}


#: Patients, a number of whole leaves, whose counts a task makes at once.
CHUNK = 16 * D.LEAF
#: Weighed cells that a task holds at once where groups are small, and rows that it returns at once.
CELLS = 1 << 19


def _indexed(patients: DataFrame, site: str, patient: str) -> tuple[DataFrame, dict]:
    """(site, patient, _i): the patients of each site numbered from 0, and the sites' sizes."""
    own, _ = kept(positions(patients.select(site, patient).distinct(), [site], [patient], "_i"), "patients")
    # a row for each site
    return own, {r[0]: r[1] for r in own.groupBy(site).agg(F.count("*")).collect()}


def _dealt(df: DataFrame, site: str, sizes: dict) -> DataFrame:
    """df(site, _i, ...) with each chunk of a site's patients together and a task's chunks beside each other, for mapInPandas.

    A row's task follows from its number, so nothing is sampled and df is computed once.
    """
    first, chunks = {}, 0
    for s, n in sizes.items():
        first[s], chunks = chunks, chunks - (-n // CHUNK)
    parts = max(1, min(chunks, 3 * df.sparkSession.sparkContext.defaultParallelism))
    kind = df.schema[site].dataType
    known = [F.create_map(*(c for s, k in first.items() if s is not None for c in (F.lit(s).cast(kind), F.lit(k))))[F.col(site)]] if any(s is not None for s in first) else []
    chunked = df.withColumn("_chunk", F.floor(F.col("_i") / CHUNK).cast("int"))
    part = F.floor((F.coalesce(*known, F.lit(first.get(None, 0))) + F.col("_chunk")) * F.lit(parts) / F.lit(max(1, chunks))).cast("int")
    return chunked.repartitionById(parts, part).sortWithinPartitions(site, "_chunk")


def _chunks(batches, site: str) -> Iterator[tuple[object, int, pd.DataFrame]]:
    """(site, chunk, rows) of a sorted partition; a chunk may lie in several batches."""
    held, at = [], None
    for batch in batches:
        for key, rows in batch.groupby([site, "_chunk"], sort=False):
            if key != at and held:
                yield *at, pd.concat(held)
                held = []
            at = key
            held.append(rows)
    if held:
        yield *at, pd.concat(held)


def _drawn(batches, site: str, seed: str, sizes: dict, replicates: int) -> Iterator[tuple[object, int, pd.DataFrame, np.ndarray]]:
    """(site, chunk, rows, counts) of a sorted partition; the tree of a site is walked once."""
    leaves, trees = CHUNK // D.LEAF, {}
    for s, chunk, rows in _chunks(batches, site):
        if s not in trees:
            trees[s] = D.Leaves(D.site_base(seed, s), sizes[s], replicates)
        yield s, chunk, rows, trees[s].counts(chunk * leaves, (chunk + 1) * leaves)


def _kind(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def patient_counts(patients: DataFrame, site: str, patient: str, replicates: int, seed: str) -> DataFrame:
    """B1: (site, patient, rep, n): how often each patient is drawn in each replicate, as many draws as the site has patients; undrawn ones have no row."""
    each = patient_weights(patients, site, patient, replicates, seed).select(site, patient, F.posexplode("weights").alias("rep", "n"))
    return each.where("n > 0").withColumn("n", F.col("n").cast("long"))


def patient_weights(patients: DataFrame, site: str, patient: str, replicates: int, seed: str) -> DataFrame:
    """B1: (site, patient, weights array<smallint>): how often a patient is drawn in each replicate."""
    own, sizes = _indexed(patients, site, patient)

    def run(batches):
        kinds = {}

        def frames():
            for batch in batches:
                kinds.update(zip(batch.schema.names, batch.schema.types))
                yield batch.to_pandas()

        for s, chunk, rows, w in _drawn(frames(), site, seed, sizes, replicates):
            w = w.astype(np.int16).T[rows["_i"].to_numpy() - chunk * CHUNK]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * replicates), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(s, kinds[site]), len(w)), pa.array(rows[patient], kinds[patient]), lists], [site, patient, "weights"])

    return _dealt(own, site, sizes).mapInArrow(run, f"{_kind(own, site, patient)}, weights array<smallint>")


def with_weights(df: DataFrame, patients: DataFrame, site: str, patient: str, replicates: int, seed: str) -> DataFrame:
    """df with its patients' weights. Spark takes an array for one number, so its guess of their size would broadcast them; they are to be shuffled."""
    return df.join(patient_weights(patients, site, patient, replicates, seed).hint("merge"), [site, patient])


def replicate_sums(patient_sums: DataFrame, patients: DataFrame, site: str, patient: str, by: list[str], columns: list[str], replicates: int, seed: str) -> DataFrame:
    """(rep, site, by, columns): sums over the patients that each replicate draws, as patient_counts draws them.

    One draw of a site serves all its groups. A chunk of patients is a matrix of counts
    that weighs the chunk's sums; a task holds replicates x groups sums of its chunks.
    Where most patients have most groups, these lie side by side in one matrix.
    """
    own, sizes = _indexed(patients, site, patient)
    sums = patient_sums.join(own, [site, patient]).select(site, "_i", *by, *(F.col(c).cast("double").alias(c) for c in columns))
    size = len(columns)

    def run(batches):
        numbers: dict[tuple, int] = {}
        held = np.zeros((0, replicates, size))
        for s, chunk, rows, w in _drawn(batches, site, seed, sizes, replicates):
            w = w.astype(float)
            at, x = rows["_i"].to_numpy() - chunk * CHUNK, rows[columns].to_numpy(float)
            group = rows.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(rows), int)
            keys = rows[by].iloc[np.unique(group, return_index=True)[1]].itertuples(index=False, name=None) if by else [()]
            own = np.array([numbers.setdefault((s, *k), len(numbers)) for k in keys])
            if len(numbers) > len(held):
                held = np.concatenate((held, np.zeros((max(len(numbers) - len(held), len(held) // 2), replicates, size))))
            if len(own) * w.shape[1] <= 4 * len(rows):
                laid = np.zeros((w.shape[1], len(own), size))
                np.add.at(laid, (at, group), x)
                held[own] += (w @ laid.reshape(len(laid), -1)).reshape(replicates, len(own), size).transpose(1, 0, 2)
                continue
            order = np.argsort(group, kind="stable")
            step = max(1, CELLS // replicates)
            for rest in range(0, len(order), step):
                part = order[rest : rest + step]
                starts = np.flatnonzero(np.diff(group[part], prepend=-1))
                drawn, whose = w[:, at[part]], own[group[part[starts]]]
                for k in range(size):
                    held[whose, :, k] += np.add.reduceat(drawn * x[part, k], starts, axis=1).T
        keys, step = list(numbers), max(1, CELLS // replicates)
        for i in range(0, len(keys), step):
            some = keys[i : i + step]
            named = {c: pd.Series([k[n] for k in some]).repeat(replicates).to_numpy() for n, c in enumerate([site, *by])}
            made = held[i : i + len(some)].reshape(-1, size)
            yield pd.DataFrame({"rep": np.tile(np.arange(replicates), len(some)), **named, **{c: made[:, k] for k, c in enumerate(columns)}})

    ddl = f"rep int, {_kind(sums, site, *by)}, " + ", ".join(f"`{c}` double" for c in columns)
    return _dealt(sums, site, sizes).mapInPandas(run, ddl).groupBy("rep", site, *by).agg(*(F.sum(c).alias(c) for c in columns))


def percentile_interval(replicates: DataFrame, by: list[str], value: str, level: float = 0.95, strict: bool = True) -> DataFrame:
    """(by, low, high): percentile interval. strict: a replicate without a value raises; else it is left out."""
    q = F.percentile(value, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    v = F.coalesce(F.col(value), F.raise_error(F.lit("a replicate has no value")).cast("double")) if strict else F.col(value)
    got = replicates.withColumn(value, v).groupBy(*by).agg(q.alias("q"))
    return got.select(*by, F.round(F.col("q")[0], DIGITS).alias("low"), F.round(F.col("q")[1], DIGITS).alias("high"))


def p_value(value: str, floor: bool = True) -> Column:
    """B5, an aggregate: 2 (min(#<=0, #>=0) + 1) / (B + 1) capped at 1, or 2 min(share <= 0, 1 - share)."""
    v = F.col(value)
    if floor:
        low, high = F.count_if(v <= 0), F.count_if(v >= 0)
        return F.round(F.least(F.lit(1.0), 2.0 * (F.least(low, high) + 1) / (F.count(v) + 1)), DIGITS)
    share = F.avg(F.when(v <= 0, 1.0).when(v.isNotNull(), 0.0))
    return F.round(F.least(F.lit(1.0), 2 * F.least(share, 1 - share)), DIGITS)


def holm(df: DataFrame, family: list[str], name: str, p: str) -> DataFrame:
    """Df with holm: p times (m - i) for the i-th smallest, running maximum, capped at 1, in each family; ties by name."""
    w = Window.partitionBy(*family)
    order = w.orderBy(p, name)
    raised = df.withColumns({"_i": F.row_number().over(order) - 1, "_m": F.count("*").over(w)})
    run = Window.partitionBy(*family).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return raised.withColumn("holm", F.round(F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i")) * F.col(p))).over(run), DIGITS)).drop("_i", "_m")


def benjamini_hochberg(df: DataFrame, family: list[str], name: str, p: str) -> DataFrame:
    """Df with bh: the least of p_j m / j over j >= i for the i-th smallest p, capped at 1, in each family; ties by name."""
    w = Window.partitionBy(*family)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(p, name)), "_m": F.count("*").over(w)})
    down = Window.partitionBy(*family).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("bh", F.round(F.min(F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_i"))).over(down), DIGITS)).drop("_i", "_m")


def decide(point: Column, low: Column, high: Column, materiality: float = 0.02, direction: str = "greater_than_zero") -> Column:
    """The first rule: struct of excludes_zero, supports, material, confirmed, reversed."""
    outside = (low > 0) | (high < 0)
    supports = outside if direction == "any" else low > 0
    material = F.abs(point) >= materiality if direction == "any" else point >= (materiality if direction == "greater_than_zero" else 0.0)
    return F.struct(outside.alias("excludes_zero"), supports.alias("supports"), material.alias("material"), (supports & material).alias("confirmed"), (outside & ~supports & (F.abs(point) >= materiality)).alias("reversed"))


def verdict(point: Column, low: Column, high: Column, direction: str = "greater", materiality: float | None = 0.02) -> Column:
    """The second rule: one of five labels. An endpoint at 0 doesn't exclude it; a point at materiality reaches it.

    Null, NaN and infinite inputs, and an interval that ends before it begins, raise when read.
    """
    if direction not in ("greater", "greater_or_equal", "less"):
        raise ValueError(f"no such direction: {direction}")
    if materiality is not None and materiality < 0:
        raise ValueError("materiality must not be negative")
    sign = -1.0 if direction == "less" else 1.0
    p, a, b = sign * point, F.least(sign * low, sign * high), F.greatest(sign * low, sign * high)
    inf = F.lit(float("inf"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)
    sound = fine(point) & fine(low) & fine(high) & (low <= high)
    reaches = F.lit(True) if materiality is None else p >= materiality
    large = F.lit(False) if materiality is None else F.abs(p) >= materiality
    label = F.when(a > 0, F.when(reaches, "confirmed").otherwise("same_direction_not_material")).when(b < 0, F.when(large, "opposite_direction_material").otherwise("opposite_direction_not_material")).otherwise("inconclusive")
    return F.when(~sound, F.raise_error(F.lit("a verdict needs a finite point and interval")).cast("string")).otherwise(label)


def registered_verdict(hypothesis: Column, point: Column, low: Column, high: Column) -> Column:
    """The verdict by the hypothesis's registered rule; an unregistered one raises when read."""
    out = F.raise_error(F.concat(F.lit("not registered: "), hypothesis)).cast("string")
    for h, (direction, materiality) in RULES.items():
        out = F.when(hypothesis == h, verdict(point, low, high, direction, materiality)).otherwise(out)
    return out


def short_label(label: Column) -> Column:
    """A verdict in words."""
    out = F.lit(None).cast("string")
    for k, v in SHORT.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def reproduction(new: DataFrame, stored: DataFrame, by: list[str], columns: list[str], tolerance: float = 1.5e-6) -> DataFrame:
    """(column, compared, difference, within): new estimates against stored ones."""
    both = new.select(*by, F.struct(*columns).alias("x")).join(stored.select(*by, F.struct(*columns).alias("z")), by)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.abs(F.col(f"x.{c}") - F.col(f"z.{c}")).alias("d")) for c in columns)))
    return both.select(pairs.alias("p")).groupBy("p.column").agg(F.count("p.d").alias("compared"), F.round(F.max("p.d"), 9).alias("difference"), (F.max("p.d") <= tolerance).alias("within"))


def contrast_family(replicates: DataFrame, points: DataFrame, by: list[str], value: str = "risk", source: str = "source", external: str = "external", conditions: tuple[str, str, str] = ("C0", "C1", "C2"), reference: str | None = None, model: str = "model") -> DataFrame:
    """(by, model, hypothesis, site, contrast, point, low, high, low6, high6, p, verdict) of H1 to H4.

    replicates has (rep, site, model, condition, by, value), points the same without rep.
    H1: external - source of C0. H2: the change of that gap under C1 and C2. H3: the
    C0 gap less the reference model's. H4: C2 - C1 at each site. low6 and high6 are the
    interval at 1 - 0.05 / 6.
    """
    c0, c1, c2 = conditions

    def table(df: DataFrame, keys: list[str]) -> DataFrame:
        at = lambda s, c: F.max(F.when((F.col("site") == s) & (F.col("condition") == c), F.col(value)))
        flat = df.groupBy(*keys, model).agg(*(at(s, c).alias(f"{s[0]}{i}") for s in (source, external) for i, c in enumerate((c0, c1, c2))))
        s, e = source[0], external[0]
        col = F.col
        gap = lambda i: col(f"{e}{i}") - col(f"{s}{i}")
        rows = [("H1", "", "gap", gap(0)), ("H2", "", "interaction C1", gap(1) - gap(0)), ("H2", "", "interaction C2", gap(2) - gap(0)), ("H4", source, "C2 - C1", col(f"{s}2") - col(f"{s}1")), ("H4", external, "C2 - C1", col(f"{e}2") - col(f"{e}1"))]
        if reference:
            base = flat.where(F.col(model) == reference).select(*keys, gap(0).alias("_g"))
            flat = flat.join(base, keys) if keys else flat.join(F.broadcast(base))
            rows.append(("H3", "", f"gap over {reference}", gap(0) - col("_g")))
        each = F.explode(F.array(*(F.struct(F.lit(h).alias("hypothesis"), F.lit(w).alias("site"), F.lit(n).alias("contrast"), d.alias("d")) for h, w, n, d in rows)))
        return flat.select(*keys, model, each.alias("x")).select(*keys, model, "x.*")

    names = [*by, model, "hypothesis", "site", "contrast"]
    six = 0.05 / 6
    q = F.percentile("d", F.array(*map(F.lit, (0.025, 0.975, six / 2, 1 - six / 2))))
    draws = table(replicates, ["rep", *by]).groupBy(*names).agg(q.alias("q"), p_value("d").alias("p"))
    joined = table(points, by).withColumnRenamed("d", "point").join(draws, names)
    r = lambda c: F.round(c, DIGITS)
    cols = [r(F.col("q")[i]).alias(k) for i, k in enumerate(("low", "high", "low6", "high6"))]
    label = registered_verdict(F.col("hypothesis"), F.col("point"), F.col("q")[0], F.col("q")[1])
    return joined.select(*names, r(F.col("point")).alias("point"), *cols, "p", label.alias("verdict"))


def uncertainty_ratio(evaluation: DataFrame, calibration: DataFrame, by: list[str]) -> DataFrame:
    """(by, evaluation_sd, ratio): evaluation sd (high - low) / 3.92, and calibration sd over it."""
    both = evaluation.select(*by, ((F.col("high") - F.col("low")) / 3.92).alias("e")).join(calibration.select(*by, "sd"), by)
    return both.select(*by, F.round("e", DIGITS).alias("evaluation_sd"), F.round(F.try_divide("sd", "e"), DIGITS).alias("ratio"))
