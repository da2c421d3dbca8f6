"""Table profiles, data contracts, leak checks and check rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortaudit.operators.audit import DIGITS, count_if, ratio

SEVERITIES = {"PASS": "info", "WARN": "warning", "FAIL": "error"}
# Section markers that a model's context must not hold, and column names it must not read.
FORBIDDEN_MARKERS = ("FINDINGS:", "IMPRESSION:", "CONCLUSION:")
FORBIDDEN_COLUMNS = ("findings", "impression", "report", "label", "target")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows, nulls, blanks, distinct values, unique without nulls.

    What is counted are digests of 16 bytes, not the values themselves.
    """
    text = lambda c: F.col(c).cast("string")
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.unhex(F.md5(text(c))).alias("digest"), (F.trim(text(c)) == "").alias("blank"))
    flat = df.select(F.explode(F.array(*map(cell, columns))).alias("x")).select("x.*")
    # equal digests meet where the rows lie before they are sent on
    per = flat.groupBy("column", "digest").agg(F.count("*").alias("n"), F.bool_or("blank").alias("blank"))
    got = per.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("digest").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("blanks"), F.count("digest").alias("distinct"))
    return got.withColumn("unique", (F.col("distinct") == F.col("rows")) & (F.col("nulls") == 0))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: groups of equal rows and the rows beyond the first of each."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).where("_n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra"))


def column_check(df: DataFrame, expected: list[str]) -> dict:
    """Which expected columns are missing, which are extra, and whether the order is the expected one."""
    return {"missing": [c for c in expected if c not in df.columns], "extra": [c for c in df.columns if c not in expected], "ordered": df.columns == expected}


def key_checks(df: DataFrame, key: list[str], formats: dict[str, str]) -> DataFrame:
    """One row: whether the key is unique without nulls, and for each column whether all values match its format whole."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    # distinct keys are counted by grouping, so a wide key makes no wide set
    shapes = [F.coalesce(F.bool_and(F.col(c).cast("string").rlike(f"^(?:{p})$")), F.lit(True)).alias(f"{c}_format") for c, p in formats.items()]
    rows = df.agg(count_if(null).alias("null_keys"), *shapes)
    repeats = df.groupBy(*key).agg(F.count("*").alias("_n")).agg(count_if(F.col("_n") > 1).alias("repeated_keys"))
    return rows.join(F.broadcast(repeats)).withColumn("is_key", (F.col("null_keys") == 0) & (F.col("repeated_keys") == 0))


def path_checks(df: DataFrame, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """One row: paths that match the pattern, and for each group whether it equals its column everywhere."""
    ok = F.col(path).rlike(pattern)
    same = [F.coalesce(F.bool_and(F.when(ok, F.regexp_extract(path, pattern, i + 1) == F.col(c).cast("string"))), F.lit(True)).alias(f"{c}_agrees") for i, c in enumerate(columns)]
    return df.agg(F.count("*").alias("rows"), count_if(ok).alias("matching"), *same)


def role_coverage(df: DataFrame, roles: list[str]) -> DataFrame:
    """A row for each role column: populated, null, coverage and distinct values; and role `any` for rows with some role and distinct values over all.

    Digests of 16 bytes are grouped, not values, and one grouping serves all roles. An
    empty table has zeros and no coverage.
    """
    cells = F.array(*(F.struct(F.lit(i).alias("role"), F.unhex(F.md5(F.col(r).cast("string"))).alias("digest")) for i, r in enumerate(roles)))
    per = df.select(F.explode(cells).alias("x")).groupBy("x.digest").agg(*(count_if(F.col("x.role") == i).alias(f"n{i}") for i in range(len(roles))))
    there, zero = F.col("digest").isNotNull(), F.lit(0).cast("long")
    rows = lambda i, ok: F.coalesce(F.sum(F.when(ok, F.col(f"n{i}"))), zero)
    role = lambda i, r: F.struct(F.lit(r).alias("role"), rows(i, there).alias("populated"), rows(i, ~there).alias("null"), F.coalesce(count_if(there & (F.col(f"n{i}") > 0)), zero).alias("distinct"))
    found = per.agg(F.array(*(role(i, r) for i, r in enumerate(roles))).alias("roles"), F.count("digest").alias("distinct"))
    some = F.coalesce(*(F.col(r).cast("string") for r in roles))
    both = found.join(F.broadcast(df.agg(F.count(some).alias("populated"), F.coalesce(count_if(some.isNull()), zero).alias("null"))))
    every = F.struct(F.lit("any").alias("role"), "populated", "null", "distinct")
    flat = both.select(F.explode(F.concat("roles", F.array(every))).alias("x")).select("x.*")
    return flat.select("role", "populated", "null", ratio(F.col("populated"), F.col("populated") + F.col("null")).alias("coverage"), "distinct")


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """One row of the sizes of a key's groups: quantiles, mean and extremes."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95, 0.99))))
    got = n.agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.round(F.avg("n"), DIGITS).alias("mean"), F.max("n").alias("most"), q.alias("q"))
    return got.select("groups", "least", "mean", "most", *(F.col("q")[i].alias(k) for i, k in enumerate(("p25", "p50", "p75", "p95", "p99"))))


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """Groups by their size."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def member_audit(files: DataFrame, expected: DataFrame, pattern: str, key_type: str = "long") -> DataFrame:
    """One row over (name, size): files of the convention, others, repeated names, depths, sizes, empty files, and ids missing from or beyond expected(id)."""
    base = F.regexp_extract("name", "([^/]+)$", 1)
    rows = files.select("name", "size", base.rlike(f"^(?:{pattern})$").alias("ok"), F.regexp_extract(base, pattern, 1).try_cast(key_type).alias("id"), (F.size(F.split("name", "/")) - 1).alias("depth"))
    one = rows.agg(count_if(F.col("ok")).alias("named"), count_if(~F.col("ok")).alias("others"), F.min("depth").alias("least_depth"), F.max("depth").alias("most_depth"), F.min("size").alias("least_size"), F.round(F.avg("size"), DIGITS).alias("mean_size"), F.max("size").alias("most_size"), count_if(F.col("size") == 0).alias("empty"))
    twice = rows.groupBy("name").agg(F.count("*").alias("n")).agg(count_if(F.col("n") > 1).alias("repeated"))
    ids = rows.where("ok").select("id").distinct().withColumn("f", F.lit(1)).join(expected.select("id").distinct().withColumn("e", F.lit(1)), "id", "full_outer")
    sides = ids.agg(count_if(F.col("f").isNull()).alias("missing"), count_if(F.col("e").isNull()).alias("beyond"))
    return one.join(F.broadcast(twice)).join(F.broadcast(sides))


_CHECKS = T.StructType([T.StructField(c, T.StringType()) for c in ("check_id", "category", "target", "expectation", "observed", "status", "severity", "notes")])


def check_row(df: DataFrame, check_id: str, category: str, target: str, violations: Column, severity: str = "error", notes: str = "") -> DataFrame:
    """A check row from an aggregate that counts violations; none pass."""
    n = df.agg(F.coalesce(violations, F.lit(0)).alias("n"))
    status = F.when(F.col("n") == 0, "PASS").when(F.lit(severity == "warning"), "WARN").otherwise("FAIL")
    return n.select(F.lit(check_id).alias("check_id"), F.lit(category).alias("category"), F.lit(target).alias("target"), F.lit("0 violations").alias("expectation"), F.col("n").cast("string").alias("observed"), status.alias("status"), F.when(F.col("n") == 0, "info").otherwise(severity).alias("severity"), F.lit(notes).alias("notes"))


def check_summary(checks: DataFrame) -> DataFrame:
    """Checks by status."""
    return checks.groupBy("status").agg(F.count("*").alias("checks"))


def contract_violations(df: DataFrame, ids: list[str], image: str, parents: list[tuple[str, str]], labels: list[str], probabilities: list[str], context: str, state: str, domains: dict[str, list[str]]) -> DataFrame:
    """(rule, violations): blank ids, repeated images, children of several parents, labels beyond 0 and 1,
    probabilities outside [0, 1], context states that don't fit the text, and values outside their lists.

    Row rules are one pass; each parent rule is one grouping. Missing columns raise.
    """
    need = [*ids, image, *labels, *probabilities, context, state, *domains]
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    bad = {f"blank:{c}": blank(c) for c in ids}
    bad |= {f"label:{c}": ~F.coalesce(F.col(c).isin(0, 1), F.lit(False)) for c in labels}
    bad |= {f"probability:{c}": ~F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False)) for c in probabilities}
    bad |= {f"domain:{c}": ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in domains.items()}
    bad["state"] = (blank(context) & (F.col(state) != "absent")) | (~blank(context) & (F.col(state) == "absent"))
    one = df.agg(*(count_if(c).alias(k) for k, c in bad.items()))
    rows = one.unpivot([], list(bad), "rule", "violations")
    repeats = df.groupBy(image).agg(F.count("*").alias("n")).agg(F.lit("repeated").alias("rule"), count_if(F.col("n") > 1).alias("violations"))
    out = rows.unionByName(repeats)
    for child, parent in parents:
        several = df.groupBy(child).agg(F.count_distinct(parent).alias("n")).agg(F.lit(f"parent:{child}").alias("rule"), count_if(F.col("n") > 1).alias("violations"))
        out = out.unionByName(several)
    return out


def split_isolation(df: DataFrame, patient: str, split: str, site: str, allowed: dict[str, list[str]]) -> DataFrame:
    """One row: patients in several splits and rows whose split their site may not have."""
    fine = reduce(lambda a, b: a | b, ((F.col(site) == s) & F.col(split).isin(v) for s, v in allowed.items()))
    rows = df.agg(count_if(~F.coalesce(fine, F.lit(False))).alias("forbidden_rows"))
    spread = df.groupBy(patient).agg(F.count_distinct(split).alias("n")).agg(count_if(F.col("n") > 1).alias("patients_in_several"))
    return spread.join(F.broadcast(rows))


def require(purpose: str, tier: str, permitted: dict[str, list[str]]) -> str:
    """The tier, if the purpose may read it; else raises."""
    if tier not in permitted.get(purpose, []):
        raise PermissionError(f"{purpose} may not read {tier}")
    return tier


def require_source(df: DataFrame, site: str, split: str, source: str, calibration: str) -> DataFrame:
    """K4's guard: df itself; reading a row that isn't the source site's calibration raises."""
    good = (F.col(site) == source) & (F.col(split) == calibration)
    return df.withColumn(site, F.when(F.coalesce(good, F.lit(False)), F.col(site)).otherwise(F.raise_error(F.lit("only calibration rows of the source site may fit a policy")).cast("string")))


def input_columns(columns: list[str], forbidden: tuple[str, ...] = FORBIDDEN_COLUMNS) -> list[str]:
    """D3: the columns, if none has a forbidden word in its name; else raises."""
    if bad := [c for c in columns if any(f in c.lower() for f in forbidden)]:
        raise ValueError(f"a model may not read {bad}")
    return columns


def marker_counts(df: DataFrame, text: str, markers: tuple[str, ...] = FORBIDDEN_MARKERS) -> DataFrame:
    """D3: (marker, rows): rows whose upper-cased text holds a forbidden section marker."""
    one = df.agg(*(count_if(F.contains(F.upper(text), F.lit(m))).alias(m) for m in markers))
    return one.unpivot([], list(markers), "marker", "rows")


def leak_scan(df: DataFrame, patterns: dict[str, str], longest: int = 200) -> DataFrame:
    """(column, pattern, cells): cells of string columns that match a pattern or are longer than `longest`; columns without any are left out."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    flat = df.select(*columns).unpivot([], columns, "column", "value")
    counts = flat.groupBy("column").agg(*(count_if(F.col("value").rlike(p)).alias(k) for k, p in patterns.items()), count_if(F.length("value") > longest).alias("long_text"))
    return counts.unpivot(["column"], [*patterns, "long_text"], "pattern", "cells").where("cells > 0")


def payload_scan(df: DataFrame, column: str, keys: list[str], values: str) -> DataFrame:
    """One row: rows of a nested payload with a restricted key, and with a restricted value, at any depth."""
    text = F.to_json(column)
    named = reduce(lambda a, b: a | b, (text.rlike(f'(?i)"{k}"\\s*:') for k in keys))
    return df.agg(count_if(named).alias("key_rows"), count_if(text.rlike(values)).alias("value_rows"))


def form_violations(reads: DataFrame, required: list[str], domains: dict[str, list[str]]) -> DataFrame:
    """Reads with violations, the names of fields that are blank though required or outside their list."""
    bad = [F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(c)) for c in required]
    bad += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.lit(c)) for c, v in domains.items()]
    return reads.withColumn("violations", F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*bad))))))


def empty_checks(spark: SparkSession) -> DataFrame:
    """A table of check rows without rows, to add to."""
    return spark.createDataFrame([], _CHECKS)
