"""Column expressions on labels, decisions, paths and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortaudit.functions.text import _c

VARIANTS = ("primary", "unmentioned_negative", "uncertain_positive", "uncertain_negative")
#: Probabilities are kept this far from 0 and 1 before a logit.
CLIP = 1e-6


def frontal(columns: list[str], view: str | None, names: list[str]) -> Column:
    """Whether the upper-cased view is one of names; true where there is no view column."""
    return F.coalesce(F.upper(F.col(view)).isin([n.upper() for n in names]), F.lit(False)) if view in columns else F.lit(True)


def parse_path(path: Column | str) -> Column:
    """Struct of split, patient, study and file of split/patient<n>/study<n>/file, or null."""
    shape = r"^([^/]+)/(patient[0-9]+)/(study[0-9]+)/([^/]+)$"
    part = lambda i: F.regexp_extract(_c(path), shape, i)
    return F.when(_c(path).rlike(shape), F.struct(part(1).alias("split"), part(2).alias("patient"), part(3).alias("study"), part(4).alias("file")))


def study_key(path: Column | str) -> Column:
    """Patient and study joined by a slash, or null where the path has another shape."""
    p = parse_path(path)
    return F.when(p.isNotNull(), F.concat(p["patient"], F.lit("/"), p["study"]))


def view_number(file: Column | str) -> Column:
    """P5: the number after `view` in a file name, in either case, else null."""
    return F.regexp_extract(_c(file), r"(?i)view([0-9]+)", 1).try_cast("int")


def encode_state(value: Column | str) -> Column:
    """1, 0 and -1 stay; other numbers, words that are no numbers, and null give null."""
    v = _c(value).try_cast("double")
    return F.when(v.isin(1.0, 0.0, -1.0), v)


def state_masks(value: Column | str) -> Column:
    """Struct of known (any number), pos, neg, unc and unmentioned (null only)."""
    v = _c(value).try_cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(v.isNotNull().alias("known"), flag(v == 1).alias("pos"), flag(v == 0).alias("neg"), flag(v == -1).alias("unc"), v.isNull().alias("unmentioned"))


def label_category(value: Column | str) -> Column:
    """Pos, neg, unc, and unm for everything else."""
    v = _c(value).try_cast("double")
    return F.when(v == 1, "pos").when(v == 0, "neg").when(v == -1, "unc").otherwise("unm")


def label_variant(value: Column | str, variant: str) -> Column:
    """Struct of label (0 or 1) and mask (whether the label counts) under a variant."""
    if variant not in VARIANTS:
        raise ValueError(f"no such variant: {variant}")
    v = encode_state(value)
    y = F.when(v.isin(0.0, 1.0), v)
    if variant == "unmentioned_negative":
        y = F.when(v.isNull(), 0.0).otherwise(y)
    elif variant == "uncertain_positive":
        y = F.when(v == -1, 1.0).otherwise(y)
    elif variant == "uncertain_negative":
        y = F.when(v == -1, 0.0).otherwise(y)
    return F.struct(F.coalesce(y, F.lit(0.0)).alias("label"), y.isNotNull().alias("mask"))


def age_band(age: Column | str) -> Column:
    """0-39, 40-64, 65-79, 80+ by whole or part years, else Unknown."""
    a = _c(age).try_cast("double")
    return F.when((a > -1) & (a <= 39), "0-39").when((a > 39) & (a <= 64), "40-64").when((a > 64) & (a <= 79), "65-79").when((a > 79) & (a <= 200), "80+").otherwise("Unknown")


def view_stratum(views: Column | str) -> Column:
    """P15, an aggregate: the distinct views in order, joined by |."""
    return F.array_join(F.array_sort(F.collect_set(_c(views))), "|")


def decide(p: Column | str, threshold: Column | str) -> Column:
    """Whether the probability is at or above the threshold."""
    return _c(p) >= _c(threshold)


def confidence(p: Column | str) -> Column:
    """P17, of one target: |2p - 1|. A study's confidence is the least (or mean) over its targets."""
    return F.abs(2 * _c(p) - 1)


def logit(p: Column | str) -> Column:
    """The log-odds of p clipped by CLIP."""
    q = F.least(F.greatest(_c(p), F.lit(CLIP)), F.lit(1 - CLIP))
    return F.ln(q / (1 - q))


def threshold_margin(p: Column | str, threshold: Column | str) -> Column:
    """Distance of p from the threshold in log-odds."""
    return F.abs(logit(p) - logit(threshold))


def late_fusion(p1: Column | str, p2: Column | str) -> Column:
    """The mean of two models' probabilities, clipped as for a logit."""
    return F.least(F.greatest((_c(p1) + _c(p2)) / 2, F.lit(CLIP)), F.lit(1 - CLIP))


def report_path(image_path: Column | str) -> Column:
    """The first four parts of an image's path, as a text file."""
    return F.concat(F.substring_index(_c(image_path), "/", 4), F.lit(".txt"))


def jpeg_path(image_path: Column | str) -> Column:
    """.dcm at the end to .jpg."""
    return F.regexp_replace(_c(image_path), r"\.dcm$", ".jpg")


def class_state(index: Column | str) -> Column:
    """A labeller's class 0 to 3 as null, 1, 0 and -1."""
    return F.when(_c(index) == 1, 1.0).when(_c(index) == 2, 0.0).when(_c(index) == 3, -1.0)


def portable_hash(*parts: Column | str) -> Column:
    """A whole number below 2**32 from the parts joined by `:`; other engines compute the same from md5."""
    text = F.concat_ws(":", *(_c(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unit(*parts: Column | str) -> Column:
    """portable_hash as a number in [0, 1)."""
    return portable_hash(*parts) / F.lit(4294967296.0)
