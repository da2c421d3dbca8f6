"""Cohort audit: prevalence, missingness, leakage, structure, disagreement and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.functions import text as X
from cohortaudit.functions import values as V
from cohortaudit.operators.prefix import quantiles, running_sums, with_totals

DIGITS = 6


def count_if(condition: Column) -> Column:
    """How often a condition holds; null doesn't count."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def ratio(a: Column, b: Column, digits: int = DIGITS) -> Column:
    """a / b rounded; null where b is 0 or null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def unpivot(df: DataFrame, columns: list[str], name: str = "label", value: str = "v") -> DataFrame:
    """Label columns to rows; the other columns stay."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, columns, name, value)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """A1: count and fraction of each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    # a row for each value of the column, after the shuffle's aggregation
    return counts.withColumn("fraction", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def label_prevalence(long: DataFrame, weight: str | None = None) -> DataFrame:
    """A2: known, positive, negative, uncertain and missing counts and positive share by label."""
    s = V.state_masks("v")
    rows = long.withColumn("s", s)
    n = lambda k: count_if(F.col(f"s.{k}"))
    known, pos = n("known"), n("pos")
    out = [known.alias("n_known"), pos.alias("n_pos"), n("neg").alias("n_neg"), n("unc").alias("n_unc"), n("unmentioned").alias("n_missing"), ratio(pos, F.greatest(F.lit(1), known)).alias("prevalence")]
    if weight:
        w = F.col(weight)
        out.append(ratio(F.sum(F.when(F.col("s.pos"), w).otherwise(0.0)), F.sum(F.when(F.col("s.known"), w).otherwise(0.0))).alias("weighted_prevalence"))
    return rows.groupBy("label").agg(*out)


def leakage(long: DataFrame) -> DataFrame:
    """A3: shares of mention kinds by label and subset (all, pos, neg, unc). long has label, v, direct, synonym (structs of mentions)."""
    subset = F.explode(F.array(F.lit("all"), F.when(F.col("v") == 1, "pos").when(F.col("v") == 0, "neg").when(F.col("v") == -1, "unc").otherwise("none")))
    rows = long.withColumn("subset", subset).where("subset <> 'none'")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), DIGITS)
    either = lambda k: F.col(f"direct.{k}") | F.col(f"synonym.{k}")
    return rows.groupBy("label", "subset").agg(
        F.count("*").alias("n"), share(F.col("direct.any")).alias("direct"), share(either("any")).alias("any"), share(either("affirmed")).alias("affirmed"), share(either("negated")).alias("negated"), share(either("speculative")).alias("speculative")
    )


def leakage_table(long: DataFrame) -> DataFrame:
    """A4: direct and synonym-only mention rates by label, over all and over positives."""
    only = F.col("synonym.any") & ~F.col("direct.any")
    share = lambda c, w: F.round(F.avg(F.when(w, F.when(c, 1.0).otherwise(0.0))), DIGITS)
    every, pos = F.lit(True), F.coalesce(F.col("v") == 1, F.lit(False))
    return long.groupBy("label").agg(
        share(F.col("direct.any"), every).alias("direct_rate"), share(only, every).alias("synonym_rate"), share(F.col("direct.any"), pos).alias("direct_rate_pos"), share(only, pos).alias("synonym_rate_pos")
    )


def missingness_by_label(long: DataFrame, with_unmentioned: bool = False) -> DataFrame:
    """A5: rows and shares of absent and of low-information context by label and state."""
    state = F.when(F.col("v") == 1, "pos").when(F.col("v") == 0, "neg").when(F.col("v") == -1, "unc").otherwise("unm")
    rows = long.withColumn("label_state", state)
    if not with_unmentioned:
        rows = rows.where("label_state <> 'unm'")
    share = lambda s: F.round(F.avg(F.when(F.col("state") == s, 1.0).otherwise(0.0)), DIGITS)
    return rows.groupBy("label", "label_state").agg(F.count("*").alias("n"), share("absent").alias("absent"), share("low_information").alias("low"))


def missingness_relationship(long: DataFrame, limit: float = 0.05) -> DataFrame:
    """Spread of the absent share over label states, unmentioned ones too, and whether it reaches limit."""
    by = missingness_by_label(long, True)
    spread = F.round(F.max("absent") - F.min("absent"), DIGITS)
    return by.groupBy("label").agg(F.count("*").alias("states"), spread.alias("spread"), (spread >= limit).alias("related"))


def split_overlap(df: DataFrame, key: str = "patient", split: str = "split") -> DataFrame:
    """Distinct keys of each split (a = b) and of each pair of splits."""
    keys = df.select(F.col(key).alias("k"), F.col(split).alias("a")).where("k is not null").distinct()
    # a key's splits are few: they meet by a join on the key
    pairs = keys.join(keys.withColumnRenamed("a", "b"), "k").where("a <= b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def gate(df: DataFrame, long: DataFrame, least_usable: float = 0.5, most_missing: float = 0.5, least_pos: int = 20, most_leak: float = 0.8) -> DataFrame:
    """One row of verdicts: usable share, missing or low share, viable labels, most direct mentions among positives."""
    context = df.agg(F.avg(F.when(F.col("usable"), 1.0).otherwise(0.0)).alias("usable"), F.avg(F.when(F.col("state") != "usable", 1.0).otherwise(0.0)).alias("missing"))
    # texts are looked through only where their label is positive; labels without positives stay
    found = long.where("v = 1").groupBy("label").agg(F.count("*").alias("pos"), F.avg(F.when(F.col("direct.any"), 1.0).otherwise(0.0)).alias("direct"))
    every = long.select("label").distinct().select("label", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("double").alias("direct"))
    by = found.unionByName(every).groupBy("label").agg(F.max("pos").alias("pos"), F.coalesce(F.max("direct"), F.lit(1.0)).alias("direct"))
    labels = by.agg(count_if(F.col("pos") >= least_pos).alias("viable"), F.max("direct").alias("leak"))
    joined = context.join(F.broadcast(labels), how="inner")  # one row each
    ok = (F.col("usable") >= least_usable) & (F.col("missing") <= most_missing) & (F.col("viable") >= 1) & (F.col("leak") <= most_leak)
    return joined.select(F.round("usable", DIGITS).alias("usable"), F.round("missing", DIGITS).alias("missing"), "viable", F.round("leak", DIGITS).alias("leak"), F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))


def compare_sites(df: DataFrame, source: str, target: str) -> DataFrame:
    """A10: usable and absent shares and median tokens of two sites, their differences, and a shift flag."""
    rows = df.where(F.col("site").isin(source, target))
    pick = lambda s, c: F.when(F.col("site") == s, c)
    out = []
    for s, n in ((source, "source"), (target, "target")):
        out += [F.avg(pick(s, F.when(F.col("usable"), 1.0).otherwise(0.0))).alias(f"{n}_usable"), F.avg(pick(s, F.when(F.col("state") == "absent", 1.0).otherwise(0.0))).alias(f"{n}_absent"), F.percentile(pick(s, F.col("tokens")), 0.5).alias(f"{n}_tokens")]
    one = rows.agg(*out)
    d = lambda c: F.col(f"target_{c}") - F.col(f"source_{c}")
    shift = (F.abs(d("usable")) >= 0.05) | (F.abs(d("absent")) >= 0.05) | (F.abs(d("tokens")) >= 3)
    return one.select(*(F.round(c, DIGITS).alias(c) for c in one.columns), F.round(d("usable"), DIGITS).alias("d_usable"), F.round(d("absent"), DIGITS).alias("d_absent"), F.round(d("tokens"), DIGITS).alias("d_tokens"), shift.alias("shift"))


def structure(images: DataFrame, frontal: Column) -> DataFrame:
    """Rows, distinct patients and studies, images for each study, of all and of frontal images."""
    rows = images.withColumn("scope", F.explode(F.array(F.lit("all"), F.when(frontal, "frontal")))).where("scope is not null")
    per = rows.groupBy("scope", "study").agg(F.count("*").alias("n"), F.first("patient").alias("patient"))
    return per.groupBy("scope").agg(F.sum("n").alias("images"), F.count_distinct("patient").alias("patients"), F.count("*").alias("studies"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.round(F.avg("n"), DIGITS).alias("mean"), F.max("n").alias("most"))


def field_availability(df: DataFrame, fields: list[str], least: int, generic: list[str], weight: str) -> DataFrame:
    """Null, empty, non-empty, usable and low rates of each field, plain and weighted. Null counts as empty too."""
    w = F.col(weight)
    rows = unpivot(df.select(weight, *fields), fields, "field", "value").withColumn("f", X.context_features("value", least, generic))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), DIGITS)
    heavy = lambda c: ratio(F.sum(F.when(c, w).otherwise(0.0)), F.sum(w))
    shares = rows.groupBy("field").agg(
        share(F.col("value").isNull()).alias("null_rate"), share(~F.col("f.present")).alias("empty_rate"), share(F.col("f.usable")).alias("usable_rate"), share(F.col("f.low")).alias("low_rate"), heavy(F.col("f.present")).alias("weighted_present"), heavy(F.col("f.usable")).alias("weighted_usable"),
        *(count_if(F.col("f.tokens") < k).alias(f"below_{k}") for k in (3, 5, 10)),
    )
    middle = quantiles(rows.where("f.present").select("field", F.col("f.tokens").alias("tokens")), ["field"], "tokens", [0.5])
    return shares.join(middle.select("field", F.col("q")[0].alias("median_tokens")), "field", "left")


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the cumulative weight reaches half of the total."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("w"))
    run = with_totals(running_sums(sums, by, [(value, False)], ["w"]), sums, by, {"t": "w"})
    return run.where(F.col("cum_w") >= F.col("t") / 2 - 1e-9).groupBy(*by).agg(F.min(value).alias("median"))


def label_distribution(long: DataFrame, strata: list[str], weight: str) -> DataFrame:
    """Positive shares among known labels by label and value of each stratum, plain and weighted."""
    rows = unpivot(long.select("label", "v", weight, *strata), strata, "stratum", "value")
    pos, known = F.col("v") == 1, F.col("v").isin(0.0, 1.0)
    w = lambda c: F.sum(F.when(c, F.col(weight)).otherwise(0.0))
    return rows.groupBy("label", "stratum", "value").agg(F.count("*").alias("n"), ratio(count_if(pos), count_if(known)).alias("positive"), ratio(w(pos), w(known)).alias("weighted_positive"))


def disagreement(images: DataFrame) -> DataFrame:
    """By label and pair of states (a <= b), the studies with images in both; null is the state unm. images has study, label, v."""
    states = images.groupBy("label", "study").agg(F.array_sort(F.collect_set(V.label_category("v"))).alias("s"), F.count("*").alias("n"))
    # at most four states to a study
    a = states.withColumn("a", F.explode("s")).withColumn("b", F.explode("s")).where("a <= b and n > 1 and (a < b or size(s) = 1)")
    return a.groupBy("label", "a", "b").agg(F.count("*").alias("studies"))


def disagreement_summary(images: DataFrame) -> DataFrame:
    """By label, the studies of several images that agree and that differ."""
    states = images.groupBy("label", "study").agg(F.count_distinct(V.label_category("v")).alias("k"), F.count("*").alias("n")).where("n > 1")
    return states.groupBy("label").agg(count_if(F.col("k") == 1).alias("identical"), count_if(F.col("k") > 1).alias("differing"))


def concordant(images: DataFrame) -> DataFrame:
    """Images with concordant, whether the study's non-null values of the label are one at most."""
    w = Window.partitionBy("label", "study")
    return images.withColumn("concordant", F.coalesce(F.min("v").over(w) == F.max("v").over(w), F.lit(True)))


def image_policies(images: DataFrame) -> DataFrame:
    """Positive share under all images, study-equal weights, one image a study, and concordant studies; and their range."""
    w = Window.partitionBy("label", "study")
    rows = concordant(images).withColumn("weight", 1 / F.count("*").over(w)).withColumn("first", F.row_number().over(w.orderBy(F.coalesce("number", F.lit(10**9)), "file")) == 1)
    pos, known = F.col("v") == 1, F.col("v").isin(0.0, 1.0)
    share = lambda s: F.try_divide(F.sum(F.when(pos, s).otherwise(0.0)), F.sum(F.when(known, s).otherwise(0.0)))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    got = rows.groupBy("label").agg(share(F.lit(1.0)).alias("all_images"), share(F.col("weight")).alias("study_equal"), share(one(F.col("first"))).alias("one_image"), share(one(F.col("concordant"))).alias("concordant"))
    four = ["all_images", "study_equal", "one_image", "concordant"]
    return got.select("label", *(F.round(c, DIGITS).alias(c) for c in four), F.round(F.greatest(*four) - F.least(*four), DIGITS).alias("spread"))


def study_weights(images: DataFrame, key: str = "study") -> DataFrame:
    """Images with weight, 1 / the number of the study's images."""
    return images.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(key)))


def first_view(images: DataFrame, key: str = "study") -> DataFrame:
    """One image a study: the lowest view number, then the file name; no number is last."""
    order = Window.partitionBy(key).orderBy(F.coalesce(V.view_number("file"), F.lit(10**9)), "file")
    return images.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def prefer(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def pattern_scan(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """One row of the shares of rows that match each pattern."""
    return df.agg(F.count("*").alias("n"), *(F.round(F.avg(F.when(F.coalesce(F.col(text).rlike(p), F.lit(False)), 1.0).otherwise(0.0)), DIGITS).alias(k) for k, p in patterns.items()))


def safe_columns(df: DataFrame, drop: list[str], prefix: str = "_internal_") -> DataFrame:
    """P20: without internal columns and the named identifiers and texts."""
    return df.drop(*(c for c in df.columns if c.startswith(prefix) or c in drop))
