"""Positions and running sums over long orders, without one task holding a whole order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.sources.scratch import kept


def _sorted(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]


def ranged(df: DataFrame, by: list[str], order: list[tuple[str, bool]], parts: int) -> DataFrame:
    """df with _part: ranges of (by, order) whose numbers rise with the order in every group. To be written before it is used."""
    keys = [*(F.asc_nulls_first(b) for b in by), *_sorted(order)]
    return df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())


def running_sums(df: DataFrame, by: list[str], order: list[tuple[str, bool]], values: list[str], parts: int | None = None) -> DataFrame:
    """df with cum_<value> for each value: its sum over the rows up to each one, in groups and in the order given.

    order is (column, descending), and is to be total in each group; nulls are smallest.
    Rows are dealt into parts by ranges of the whole key, groups and all order columns of
    whatever type: Spark samples the key for splitters and finds a row's part by binary
    search, so parts follow the rows whatever values they share. The parts are written,
    so that a row keeps its part; inside them sums run by a window, and the parts' totals
    (one a part and group that meet) are carried over.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid, _ = kept(ranged(df, by, order, n), "laid")
    columns = _sorted(order)
    inside = Window.partitionBy("_part", *by).orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = laid.withColumns({f"cum_{v}": F.sum(v).over(inside) for v in values})
    totals = laid.groupBy("_part", *by).agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(F.col(c).alias(f"_k_{c}") for c in ["_part", *by]), *(F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values))
    same = F.col("_part") == F.col("_k__part")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    joined = run.join(carried, same)
    return joined.select(*df.columns, *((F.col(f"cum_{v}") + F.col(f"_b_{v}")).alias(f"cum_{v}") for v in values))


def positions(df: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """df with each row's place in its group, from 0, in ascending order."""
    got = running_sums(df.withColumn("_one", F.lit(1).cast("long")), by, [(c, False) for c in order], ["_one"])
    return got.withColumn(name, F.col("cum__one") - 1).drop("_one", "cum__one")


def with_totals(run: DataFrame, df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """run with, for each name: column of columns, df's sum of the column in the row's group."""
    totals = df.groupBy(*by).agg(*(F.sum(c).alias(n) for n, c in columns.items()))
    if not by:
        return run.join(F.broadcast(totals))  # one row
    same = reduce(and_, (F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by))
    return run.join(totals.withColumnsRenamed({b: f"_g_{b}" for b in by}), same).drop(*(f"_g_{b}" for b in by))


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, _v, _c): the values of each group and their counts, written once; null values don't count."""
    return kept(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "counts")[0]


def counted_at(counts: DataFrame, by: list[str], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """values_at of value_counts."""
    run = with_totals(running_sums(counts, by, [("_v", False)], ["_c"]), counts, by, {"n": "_c"})
    return run.groupBy(*by).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("cum__c") > place(F.col("n")), F.col("_v"))).alias(name) for name, place in places.items()))


def values_at(df: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, a column for each place): the values at the places, numbers from 0 in ascending order, given as functions of the group's count n.

    Rows are counted by value first; null values don't count.
    """
    return counted_at(value_counts(df, by, value), by, places)


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, q array<double>): exact quantiles, interpolated linearly between the two nearest values."""
    place = lambda s, n: F.lit(s) * (n - 1)
    places = {f"_{side}{i}": (lambda n, s=s, f=f: f(place(s, n))) for i, s in enumerate(shares) for side, f in (("a", F.floor), ("b", F.ceil))}
    got = values_at(df, by, value, places)
    rest = lambda s: place(s, F.col("n")) - F.floor(place(s, F.col("n")))
    return got.select(*by, F.array(*((1 - rest(s)) * F.col(f"_a{i}") + rest(s) * F.col(f"_b{i}") for i, s in enumerate(shares))).alias("q"))
