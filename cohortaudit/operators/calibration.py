"""Calibration error in bins, and the coverage that a risk allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortaudit.operators.audit import DIGITS
from cohortaudit.operators.prefix import running_sums, with_totals

BINS = 15


def coverage_at_risk(df: DataFrame, by: list[str], confidence: str, error: str, levels: list[float]) -> DataFrame:
    """(by, level, coverage, cutoff): the largest coverage whose selective risk is at most the level, and the confidence that gives it.

    A cutoff takes all rows of one confidence or none, so only the ends of ties count.
    Rows without an error don't; a level that is never reached has coverage 0 and no cutoff.
    """
    rows = df.where(F.col(error).isNotNull() & F.col(confidence).isNotNull())
    counts = rows.groupBy(*by, F.col(confidence).alias("_c")).agg(F.count("*").alias("_n"), F.sum(F.col(error).cast("double")).alias("_e"))
    run = with_totals(running_sums(counts, by, [("_c", True)], ["_n", "_e"]), counts, by, {"_all": "_n"})
    # rounded, so that a risk at its level is on the same side of it in whatever order it was summed
    risk, share = F.round(F.col("cum__e") / F.col("cum__n"), 12), F.col("cum__n") / F.col("_all")
    met = F.filter(F.array(*map(F.lit, levels)), lambda x: risk <= x)
    each = run.select(*by, share.alias("_s"), "_c", F.explode(met).alias("level")).groupBy(*by, "level").agg(F.max(F.struct("_s", "_c")).alias("m"))
    every = counts.select(*by).distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return every.join(each, [*by, "level"], "left").select(*by, "level", F.round(F.coalesce("m._s", F.lit(0.0)), DIGITS).alias("coverage"), F.col("m._c").alias("cutoff"))


def _error(binned: DataFrame, by: list[str]) -> DataFrame:
    """(by, cells, bins, ece, mce) of (by, bin, n, p, y), sums by bin."""
    gap = F.abs(F.col("p") / F.col("n") - F.col("y") / F.col("n"))
    return binned.groupBy(*by).agg(F.sum("n").alias("cells"), F.count("*").alias("bins"), F.round(F.sum(gap * F.col("n")) / F.sum("n"), DIGITS).alias("ece"), F.round(F.max(gap), DIGITS).alias("mce"))


def _counted(df: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    """Labelled cells counted by probability."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("double")).alias("_y"))


def _binned(counts: DataFrame, by: list[str], bin_: Column) -> DataFrame:
    return counts.groupBy(*by, bin_.alias("bin")).agg(F.sum("_n").alias("n"), F.sum(F.col("_p") * F.col("_n")).alias("p"), F.sum("_y").alias("y"))


def calibration_error(df: DataFrame, by: list[str], bins: int = BINS, p: str = "p", y: str = "y") -> DataFrame:
    """(by, cells, bins, ece, mce): expected and largest calibration error in bins of equal width; 1 belongs to the last bin."""
    return _error(_binned(_counted(df, by, p, y), by, F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1))), by)


def equal_mass_error(df: DataFrame, by: list[str], bins: int = BINS, p: str = "p", y: str = "y") -> DataFrame:
    """(by, cells, bins, ece, mce): as calibration_error in bins of equal numbers of cells.

    Cells are ranked by probability; equal probabilities stay together, in the bin of the
    first of them, so there may be fewer bins.
    """
    counts = _counted(df, by, p, y)
    run = with_totals(running_sums(counts, by, [("_p", False)], ["_n"]), counts, by, {"_all": "_n"})
    return _error(_binned(run, by, F.floor((F.col("cum__n") - F.col("_n")) * bins / F.col("_all"))), by)
