"""Context interventions: original, removed, and swapped with another patient's."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.functions import values as V
from cohortaudit.operators.audit import DIGITS, count_if
from cohortaudit.operators.prefix import positions
from cohortaudit.sources.scratch import kept

# Fixed value: what stands for a removed context.
NO_CONTEXT = "[NO_CONTEXT]"


def original(df: DataFrame, state: str) -> DataFrame:
    """Condition C0: the rows of natural state N1, unchanged."""
    return df.where(F.col(state) == "N1")


def removed(df: DataFrame, context: str) -> DataFrame:
    """Condition C1: every context is NO_CONTEXT."""
    return df.withColumn(context, F.lit(NO_CONTEXT))


def _blocks(df: DataFrame, strata: list[str], patient: str, tie: str) -> DataFrame:
    """df with _k, its place in the stratum, _n rows, and its patient's block [_b, _e] and size."""
    own = positions(df, strata, [patient, tie], "_k")
    block = Window.partitionBy(*strata, patient)
    blocked = own.withColumns({"_b": F.min("_k").over(block), "_e": F.max("_k").over(block)})
    sizes = blocked.groupBy(*strata).agg(F.count("*").alias("_n"), F.max(F.col("_e") - F.col("_b") + 1).alias("_m"))
    # a row for each stratum
    return blocked.join(F.broadcast(sizes), strata)


def _offset(strata: list[str], seed: str) -> Column:
    return 1 + F.pmod(V.portable_hash(F.lit(seed), *strata), F.greatest(F.col("_n") - 1, F.lit(1)))


def swapped(df: DataFrame, strata: list[str], patient: str, tie: str, context: str, seed: str, offset: Column | None = None) -> DataFrame:
    """Condition C2: df with the context of a donor row, and donor_<patient> and donor_<tie>.

    In a stratum, ordered by (patient, tie), row k takes row k + offset, or the next row
    after its own patient's block if that row is of the same patient. With one patient
    alone in the stratum the donor is of the same patient. Rows with a null in the
    strata keep their own context.
    """
    whole = None
    for s in strata:
        whole = F.col(s).isNotNull() if whole is None else whole & F.col(s).isNotNull()
    placed = _blocks(df.where(whole), strata, patient, tie)
    start = F.pmod(F.col("_k") + (offset if offset is not None else _offset(strata, seed)), F.col("_n"))
    start = F.when(F.col("_n") == 1, F.col("_k")).otherwise(start)
    alone = F.col("_m") == F.col("_n")
    donor = F.when(alone | ~start.between(F.col("_b"), F.col("_e")), start).otherwise(F.pmod(F.col("_e") + 1, F.col("_n")))
    target = placed.withColumn("_d", donor)
    giver = placed.select(*strata, F.col("_k").alias("_d"), F.col(patient).alias(f"donor_{patient}"), F.col(tie).alias(f"donor_{tie}"), F.col(context).alias("_given"))
    got = target.join(giver, [*strata, "_d"]).withColumn(context, F.col("_given")).select(*df.columns, f"donor_{patient}", f"donor_{tie}")
    alone_rows = df.where(~whole).select("*", F.col(patient).alias(f"donor_{patient}"), F.col(tie).alias(f"donor_{tie}"))
    return got.unionByName(alone_rows)


def swaps(df: DataFrame, strata: list[str], patient: str, tie: str, seeds: list[str]) -> DataFrame:
    """(seed, tie, donor): the donors of swapped() under several seeds.

    Rows are placed once for all seeds; a seed is an offset in each stratum, and only
    keys are permuted: texts and predictions join by donor where they are needed. Rows
    with a null in the strata are their own donors.
    """
    whole = reduce(and_, (F.col(s).isNotNull() for s in strata))
    placed, _ = kept(_blocks(df.where(whole).select(*strata, patient, tie), strata, patient, tie), "placed")
    seeded = placed.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    start = F.pmod(F.col("_k") + 1 + F.pmod(V.portable_hash("seed", *strata), F.greatest(F.col("_n") - 1, F.lit(1))), F.col("_n"))
    start = F.when(F.col("_n") == 1, F.col("_k")).otherwise(start)
    stays = (F.col("_m") == F.col("_n")) | ~start.between(F.col("_b"), F.col("_e"))
    target = seeded.withColumn("_d", F.when(stays, start).otherwise(F.pmod(F.col("_e") + 1, F.col("_n"))))
    giver = placed.select(*strata, F.col("_k").alias("_d"), F.col(tie).alias("donor"))
    own = df.where(~whole).select(F.explode(F.array(*map(F.lit, seeds))).alias("seed"), tie, F.col(tie).alias("donor"))
    return target.join(giver, [*strata, "_d"]).select("seed", tie, "donor").unionByName(own)


def swapped_by_one_offset(df: DataFrame, strata: list[str], patient: str, tie: str, context: str, seed: str) -> DataFrame:
    """As swapped(), but one offset serves the whole stratum; a stratum without one raises when read.

    With m the largest patient's rows of n, the offsets m to n - m give every row
    another patient; the first of them from the seed's own, in a circle, is taken.
    """
    start = _offset(strata, seed)
    fits = F.when(start.between(F.col("_m"), F.col("_n") - F.col("_m")), start).otherwise(F.col("_m"))
    usable = F.col("_m") * 2 <= F.col("_n")
    chosen = F.when(usable, fits).otherwise(F.raise_error(F.lit("a stratum's largest patient has over half of its rows")).cast("long"))
    return swapped(df, strata, patient, tie, context, seed, chosen)


def invariants(c0: DataFrame, c1: DataFrame, c2: DataFrame, key: str, context: str, forbidden: str) -> DataFrame:
    """One row: rows and ids that differ between conditions, C1 contexts not removed, C2 contexts that are the row's own, forbidden section headers."""
    a, b, c = (d.select(key, F.col(context).alias(n)) for d, n in ((c0, "a"), (c1, "b"), (c2, "c")))
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), key, "full_outer").join(c.withColumn("z", F.lit(1)), key, "full_outer")
    marked = F.coalesce(F.col("a").rlike(forbidden), F.lit(False)) | F.coalesce(F.col("c").rlike(forbidden), F.lit(False))
    return both.agg(
        F.count("*").alias("ids"), count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("unpaired"), count_if(~F.col("b").eqNullSafe(F.lit(NO_CONTEXT))).alias("not_removed"),
        count_if(F.col("a").eqNullSafe(F.col("c"))).alias("own_context"), count_if(marked).alias("forbidden"),
    )


def validate(c0: DataFrame, c2: DataFrame, key: str, patient: str, same: list[str]) -> DataFrame:
    """One row: unmatched ids, rows whose donor is the same patient, rows whose `same` columns changed."""
    a = c0.select(key, F.struct(*same).alias("x"))
    b = c2.select(key, F.struct(*same).alias("y"), (F.col(patient) == F.col(f"donor_{patient}")).alias("own"))
    both = a.join(b, key, "full_outer")
    return both.agg(count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"), count_if(F.col("own")).alias("same_patient"), count_if(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col("x").eqNullSafe(F.col("y"))).alias("changed"))


def swap_audit(c2: DataFrame, original_context: DataFrame, key: str, patient: str, tie: str, study: str, context: str, mentions: Column) -> DataFrame:
    """One row over swapped rows: same patient, self, identical text of another patient, studies with several donors, another profile of mentions, mean tokens of the texts."""
    joined = c2.join(original_context.select(key, F.col(context).alias("_own")), key)
    same = F.col(patient) == F.col(f"donor_{patient}")
    words = F.size(F.filter(F.split(F.coalesce(F.col(context), F.lit("")), r"\s+"), lambda w: w != ""))
    per = joined.agg(
        F.count("*").alias("rows"), count_if(same).alias("same_patient"), count_if(F.col(tie) == F.col(f"donor_{tie}")).alias("self"), count_if(~same & F.col(context).eqNullSafe(F.col("_own"))).alias("identical_text"),
        count_if(mentions).alias("other_profile"), F.round(F.avg(words), DIGITS).alias("mean_tokens"),
    )
    donors = c2.groupBy(study).agg(F.count_distinct(f"donor_{tie}").alias("n")).agg(count_if(F.col("n") > 1).alias("several_donors"))
    return per.join(F.broadcast(donors))


def image_only_drift(passes: DataFrame, keys: list[str], condition: str, p: str, model: str, most: float = 1e-5) -> DataFrame:
    """By model: the largest change of a probability over conditions and whether it is within `most`."""
    spread = passes.groupBy(model, *keys).agg((F.max(p) - F.min(p)).alias("d"))
    return spread.groupBy(model).agg(F.round(F.max("d"), DIGITS).alias("drift"), (F.max("d") <= most).alias("invariant"))
