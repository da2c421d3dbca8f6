"""Validated joins, key reconciliation and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.operators.audit import DIGITS, count_if


def join_statistics(main: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: rows, duplicate keys, matched and one-sided keys, and by how much a left join grows the main table."""
    side = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    both = side(main, "a").join(side(labels, "b"), key, "full_outer")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    got = both.agg(
        F.sum(a).alias("main_rows"), F.sum(b).alias("label_rows"), count_if(a > 1).alias("main_duplicates"), count_if(b > 1).alias("label_duplicates"), count_if((a > 0) & (b > 0)).alias("matched"),
        count_if(b == 0).alias("main_only"), count_if(a == 0).alias("label_only"), F.sum(a * F.greatest(b, F.lit(1))).alias("grown"),
    )
    return got.select(*got.columns[:-1], F.round(F.try_divide(F.col("grown").cast("double"), F.col("main_rows")), DIGITS).alias("expansion"))


def join_labels(main: DataFrame, labels: DataFrame, key: str, duplicates: str = "fail", unmatched: str = "allow") -> DataFrame:
    """A left join on a key that is to be unique on both sides; labels' columns that clash are dropped.

    Policies are fail or allow; a failing one raises after one pass over the keys.
    """
    if "fail" in (duplicates, unmatched):
        s = join_statistics(main, labels, key).first()
        if duplicates == "fail" and (s.main_duplicates or s.label_duplicates):
            raise ValueError(f"{key} is not unique: {s.main_duplicates} in the main table, {s.label_duplicates} among labels")
        if unmatched == "fail" and (s.main_only or s.label_only):
            raise ValueError(f"{key} does not match: {s.main_only} only in the main table, {s.label_only} only among labels")
    own = [c for c in labels.columns if c == key or c not in main.columns]
    return main.join(labels.select(*own), key, "left")


def audit_chain(reports: DataFrame, labels: DataFrame, metadata: DataFrame, splits: DataFrame, key: str = "study", patient: str = "patient") -> DataFrame:
    """Reports with labels, then metadata and splits where there are any; the patient is the first known one."""
    named = lambda df, n: df.withColumnRenamed(patient, f"_{n}") if patient in df.columns else df.withColumn(f"_{n}", F.lit(None))
    sides = [named(df, n) for df, n in ((reports, "r"), (labels, "l"), (metadata, "m"), (splits, "s"))]
    joined = sides[0].join(sides[1], key).join(sides[2], key, "left").join(sides[3], key, "left")
    return joined.withColumn(patient, F.coalesce("_r", "_l", "_m", "_s")).drop("_r", "_l", "_m", "_s")


def agreement(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """One row: matched keys, those whose column differs, and whether all agree (null equals null)."""
    both = a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key)
    same = F.col("x").eqNullSafe(F.col("y"))
    return both.agg(F.count("*").alias("matched"), count_if(~same).alias("differing"), F.coalesce(F.bool_and(same), F.lit(True)).alias("agree"))


def reference_checks(pairs: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """For each (name, child, key, parent, key): child keys and those without a parent. Null keys don't count.

    Keys of all pairs lie in one table with a bit for each side; one shuffle unites the
    bits of a key, after they are united where the rows lie.
    """
    sides = [(name, df, key, bit) for name, child, ck, parent, pk in pairs for df, key, bit in ((child, ck, 1), (parent, pk, 2))]
    rows = reduce(DataFrame.unionByName, (df.where(F.col(key).isNotNull()).select(F.lit(name).alias("pair"), F.col(key).cast("string").alias("k"), F.lit(bit).alias("bit")) for name, df, key, bit in sides))
    masks = rows.groupBy("pair", "k").agg(F.bit_or("bit").alias("mask"))
    found = masks.groupBy("pair").agg(count_if(F.col("mask") != 2).alias("keys"), count_if(F.col("mask") == 1).alias("unmatched"))
    names = rows.sparkSession.createDataFrame([(n,) for n, *_ in pairs], "pair string")
    return names.join(found, "pair", "left").select("pair", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("keys", "unmatched")))


def hierarchy_checks(child: DataFrame, parent: DataFrame, key: str, grandparent: str) -> DataFrame:
    """One row: orphan children, childless parents, and child keys of several grandparents."""
    kids = child.groupBy(key).agg(F.count_distinct(grandparent).alias("n"), F.lit(True).alias("c"))
    both = kids.join(parent.select(key, F.lit(True).alias("p")).distinct(), key, "full_outer")
    return both.agg(count_if(F.col("p").isNull()).alias("orphans"), count_if(F.col("c").isNull()).alias("childless"), count_if(F.col("n") > 1).alias("several_parents"))


def donor_labels(target: DataFrame, donor: DataFrame, key: str, column: str) -> DataFrame:
    """The target's rows with the donor's labels by key; no donor row gives null."""
    return target.join(donor.select(key, F.col(column).alias("donor_v")), key, "left")


def align(predictions: DataFrame, cohort: DataFrame, key: str, patient: str, exact: bool = True) -> DataFrame:
    """Predictions in the cohort's rows. exact: every key must be there with the same patient, else a read raises; not exact: common keys."""
    mine = cohort.select(key, F.col(patient).alias("_patient"))
    if not exact:
        return predictions.join(mine, key).where(F.col(patient).eqNullSafe(F.col("_patient"))).drop("_patient")
    joined = mine.join(predictions.withColumn("_there", F.lit(True)), key, "left")
    good = F.col("_there").isNotNull() & F.col(patient).eqNullSafe(F.col("_patient"))
    checked = F.when(good, F.col(patient)).otherwise(F.raise_error(F.concat(F.lit("no aligned prediction for "), F.col(key).cast("string"))).cast(cohort.schema[patient].dataType))
    return joined.withColumn(patient, checked).drop("_patient", "_there")


def cohort_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: keys on one side only, and keys on both whose columns differ (null equals null)."""
    left, right = a.select(key, F.struct(*columns).alias("x")), b.select(key, F.struct(*columns).alias("y"))
    both = left.join(right, key, "full_outer")
    return both.agg(count_if(F.col("y").isNull()).alias("only_a"), count_if(F.col("x").isNull()).alias("only_b"), count_if(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col("x").eqNullSafe(F.col("y"))).alias("differing"))


def pair_tables(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Two aggregate tables side by side with differences b - a; a key of one side stays with nulls."""
    left = a.select(key, *(F.col(v).alias(f"{v}_a") for v in values))
    both = left.join(b.select(key, *(F.col(v).alias(f"{v}_b") for v in values)), key, "full_outer")
    return both.select(key, *(c for v in values for c in (f"{v}_a", f"{v}_b", F.round(F.col(f"{v}_b") - F.col(f"{v}_a"), DIGITS).alias(f"{v}_difference"))))


def same_sets(named: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """By pair of tables: keys only in one, only in the other, equality and containment. Null is a key like any other.

    Each table is a bit (at most 31 tables), a key's bits are united in one shuffle, and
    the pairs meet only the numbers of keys with each mask.
    """
    rows = reduce(DataFrame.unionByName, (df.select(F.col(key), F.lit(1 << i).alias("_bit")) for i, (_, df) in enumerate(named)))
    masks = rows.groupBy(key).agg(F.bit_or("_bit").alias("_mask")).groupBy("_mask").agg(F.count("*").alias("_n"))
    pairs = [(n, m, 1 << i, 1 << j) for i, (n, _) in enumerate(named) for j, (m, _) in enumerate(named) if i < j]
    every = F.broadcast(rows.sparkSession.createDataFrame(pairs, "a string, b string, _a int, _b int"))
    lone = lambda x, y: F.coalesce(F.sum(F.when((F.col("_mask").bitwiseAND(F.col(x)) > 0) & (F.col("_mask").bitwiseAND(F.col(y)) == 0), F.col("_n"))), F.lit(0))
    got = every.join(masks, F.lit(True), "left").groupBy("a", "b").agg(lone("_a", "_b").alias("only_a"), lone("_b", "_a").alias("only_b"))
    return got.select("a", "b", "only_a", "only_b", (F.col("only_a") + F.col("only_b") == 0).alias("equal"), (F.col("only_a") == 0).alias("a_in_b"))


def expert_reference(expert: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Labels by study: positive if any image is; values other than 0 and 1 raise when read."""
    ok = lambda c: F.when(F.col(c).isin(0, 1), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be 0 or 1")).cast("int"))
    return expert.select(key, *(ok(c).alias(c) for c in columns)).groupBy(key).agg(*(F.max(c).alias(c) for c in columns))


def find_lost(candidates: DataFrame, cohort: DataFrame, key: str, value: str, lost: str = "lost") -> DataFrame:
    """(candidate id, differences): how the cohort rebuilt with each lost image present differs from the stored one.

    candidates has (lost, key, value): the rows that change if the image is present.
    Rows of the base rebuild that no candidate touches must agree already, so a
    candidate's differences are counted over its own rows.
    """
    both = candidates.join(cohort.select(key, F.col(value).alias("_stored")), key, "left")
    return both.groupBy(lost).agg(count_if(~F.col(value).eqNullSafe(F.col("_stored"))).alias("differences"))


def first_in_order(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in a total order, for results that must not depend on the input's order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
