"""Reports with sections: two header dialects, section statistics and cohort ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortaudit.functions import text as X
from cohortaudit.operators.audit import DIGITS, count_if
from cohortaudit.operators.prefix import counted_at, value_counts

# The first dialect's header and its section names.
PLAIN_HEADER = r"(?m)^\s*([A-Z][A-Z /_-]{2,40})\s*:\s*"
PLAIN_SECTIONS = {
    "history": ["history", "clinical history", "indication", "reason for examination", "reason for exam", "exam indication", "clinical indication"],
    "findings": ["findings", "finding"],
    "impression": ["impression", "conclusion"],
    "comparison": ["comparison", "comparisons"],
    "technique": ["technique", "procedure"],
}
# Fixed value: the second dialect's header.
HEADER = r"(?m)^[ \t]*([A-Z][A-Z0-9 /&'()\.\,\-\*]{0,60}?)[ \t]*:"
# Banners, words that describe views, and sections by class.
BANNER = r"(?m)^\s*(FINAL REPORT|FINAL ADDENDUM|PRELIMINARY REPORT)\s*$"
VIEW_WORDS = r"\b(?:AP|PA|LATERAL|FRONTAL|PORTABLE|UPRIGHT|SUPINE|SEMI-UPRIGHT|SEMI-ERECT|FILM|SINGLE|ONE|TWO)\b.*\b(?:CHEST|VIEW|VIEWS|RADIOGRAPH|RADIOGRAPHS)\b|\bCHEST\b.*\b(?:VIEW|VIEWS|AP|PA|LATERAL|PORTABLE|UPRIGHT)\b"
SECTIONS = {
    "pre_diagnostic": {
        "examination": ["EXAMINATION", "EXAM", "TYPE OF EXAMINATION", "STUDY", "PROCEDURE", "REPORT"],
        "indication": ["INDICATION", "CLINICAL INDICATION", "REASON FOR EXAMINATION", "REASON FOR EXAM"],
        "history": ["HISTORY", "CLINICAL HISTORY", "PATIENT HISTORY", "CLINICAL INFORMATION", "CLINICAL INFORMATION & QUESTIONS TO BE ANSWERED"],
        "technique": ["TECHNIQUE"],
        "comparison": ["COMPARISON", "COMPARISONS", "COMPARISON EXAM", "COMPARISON FILM", "REFERENCE EXAM"],
    },
    "label_source": {
        "findings": ["FINDINGS"],
        "impression": ["IMPRESSION", "CONCLUSION"],
        "findings_impression_combined": ["FINDINGS AND IMPRESSION", "FINDINGS/IMPRESSION", "IMPRESSION AND FINDINGS"],
    },
    "post_diagnostic": {
        "wet_read": ["WET READ"],
        "provisional_impression": ["PROVISIONAL FINDINGS IMPRESSION (PFI)", "PFI", "PROVISIONAL FINDINGS IMPRESSION"],
        "recommendation": ["RECOMMENDATION(S)", "RECOMMENDATIONS", "RECOMMENDATION"],
        "notification": ["NOTIFICATION", "NOTIFICATIONS"],
        "addendum": ["ADDENDUM", "FINAL ADDENDUM"],
        "comment": ["COMMENT", "COMMENTS", "NOTE"],
    },
    "administrative": {"administrative": ["DATE", "CC", "TO", "FROM"]},
}


def section_map(spark: SparkSession) -> DataFrame:
    """(header, section, class) of the second dialect: a few dozen rows."""
    rows = [(h, s, c) for c, named in SECTIONS.items() for s, headers in named.items() for h in headers]
    return spark.createDataFrame(rows, "header string, section string, class string")


def _pieces(text: Column, pattern: str) -> Column:
    """array of (pos, header, body) by one pass for headers and one for bodies; pos from 0."""
    # one element, so that each pass is made once
    cut = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("h"), F.split(text, pattern, -1).alias("b")))
    return F.transform(cut, lambda x: F.transform(x["h"], lambda h, i: F.struct(i.alias("pos"), h.alias("header"), F.get(x["b"], i + 1).alias("body"))))[0]


def parse_plain(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """rows (*keep, section, body): repeated sections joined by a line break; text before the
    first header is `prefix` if not blank, text without headers `unsectioned`."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n"), "\r", "\n")
    # a text is cut once: what is asked of generated rows isn't moved below the generator, where it would cut the text again
    cut = F.array(F.struct(F.regexp_extract_all("_t", F.lit(PLAIN_HEADER), F.lit(1)).alias("h"), F.split("_t", PLAIN_HEADER, -1).alias("b")))
    whole = df.select(*keep, t.alias("_t")).select(*keep, F.explode(cut).alias("_x"))
    first = F.when(F.size("_x.h") == 0, "unsectioned").otherwise("prefix")
    pieces = F.transform(F.col("_x.b"), lambda b, i: F.struct((i - 1).alias("pos"), F.when(i > 0, F.get(F.col("_x.h"), i - 1)).alias("header"), b.alias("body")))
    rows = whole.select(*keep, first.alias("_first"), F.explode(pieces).alias("p"))
    name = F.regexp_replace(F.replace(F.lower(F.trim(F.col("p.header"))), F.lit("_"), F.lit(" ")), r"\s+", " ")
    known = F.create_map(*(F.lit(x) for canonical, aliases in PLAIN_SECTIONS.items() for a in aliases for x in (a, canonical)))
    section = F.when(F.col("p.pos") < 0, F.col("_first")).otherwise(F.coalesce(known[name], name))
    # a blank is looked at only where a run begins, so long runs cost no more than their length
    strip = lambda c: F.regexp_replace(c, r"^\s+|(?<!\s)\s+\z", "")
    found = rows.where((F.col("p.pos") >= 0) | (F.col("_first") == "unsectioned") | F.col("p.body").rlike(r"\S")).select(*keep, section.alias("section"), F.col("p.pos").alias("pos"), strip(F.col("p.body")).alias("body"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n")
    return found.groupBy(*keep, "section").agg(strip(joined).alias("body"))


def parse_sections(df: DataFrame, text: str, keep: list[str], sections: DataFrame) -> DataFrame:
    """F8: rows (*keep, pos, header, section, class, body), a row for each header; section is null for headers that are not mapped.

    A body runs to the next header of any name. Headers match with white space collapsed and case kept.
    """
    rows = df.select(*keep, F.posexplode(_pieces(F.coalesce(F.col(text), F.lit("")), HEADER)).alias("_i", "p"))
    header = F.trim(F.regexp_replace(F.col("p.header"), r"\s+", " "))
    got = rows.select(*keep, F.col("p.pos").alias("pos"), header.alias("header"), F.regexp_replace(F.col("p.body"), r"^\s+|\s+$", "").alias("body"))
    return got.join(F.broadcast(sections), "header", "left").select(*keep, "pos", "header", "section", "class", "body")


def section_text(parsed: DataFrame, key: str, sections: list[str]) -> DataFrame:
    """F8: the bodies of some sections in their order, joined by a blank."""
    rows = parsed.where(F.col("section").isin(sections) & (F.col("body") != ""))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), " ").alias("context"))


def banner(text: str) -> Column:
    """the report's banner, or null."""
    return F.nullif(F.regexp_extract(F.col(text), BANNER, 1), F.lit(""))


def view_descriptor(text: str) -> Column:
    """whether a line describes the views."""
    return F.col(text).rlike(VIEW_WORDS)


def section_statistics(parsed: DataFrame, key: str) -> DataFrame:
    """By mapped section: reports, occurrences, repeats, empty and de-identified bodies, token summary."""
    rows = parsed.where("section is not null").withColumn("tokens", X.effective_tokens("body"))
    per = rows.groupBy("section", key).agg(F.count("*").alias("n"), count_if(F.col("body") == "").alias("empty"), F.sum(X.deid_spans("body")).alias("spans"), count_if(X.deid_only("body")).alias("only"), F.sum("tokens").alias("tokens"))
    return per.groupBy("section").agg(F.count("*").alias("reports"), F.sum("n").alias("occurrences"), count_if(F.col("n") > 1).alias("repeats"), F.sum("empty").alias("empty_bodies"), F.sum("spans").alias("deid_spans"), F.sum("only").alias("deid_only"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"))


def availability(parsed: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Reports by which of pre-diagnostic text, impression and findings they hold."""
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    filled = F.col("body") != ""
    flags = parsed.groupBy(key).agg(has((F.col("class") == "pre_diagnostic") & filled).alias("pre"), has(F.col("section") == "impression").alias("impression"), has(F.col("section") == "findings").alias("findings"))
    every = reports.select(key).join(flags, key, "left").na.fill(0, ["pre", "impression", "findings"])
    return every.groupBy("pre", "impression", "findings").agg(F.count("*").alias("reports"))


def section_pairs(parsed: DataFrame, key: str, k: int = 25) -> DataFrame:
    """The k pairs of sections (a < b) that most reports hold together; ties by name."""
    sets = parsed.where("section is not null").groupBy(key).agg(F.array_sort(F.collect_set("section")).alias("s"))
    pairs = sets.select(key, F.explode("s").alias("a"), "s").select(key, "a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("reports")).orderBy(F.desc("reports"), "a", "b").limit(k)


def order_violations(parsed: DataFrame, key: str) -> DataFrame:
    """By report, whether a pre-diagnostic section follows the first label section."""
    label, pre = F.min(F.when(F.col("class") == "label_source", F.col("pos"))), F.max(F.when(F.col("class") == "pre_diagnostic", F.col("pos")))
    return parsed.groupBy(key).agg(F.coalesce(pre > label, F.lit(False)).alias("violates"))


def unknown_headers(parsed: DataFrame, least: int = 100) -> DataFrame:
    """Headers that are not mapped, digits masked, counted; those below `least` are withheld."""
    return parsed.where("section is null").groupBy(X.mask_digits("header").alias("header")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def index_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """N, mean, whole median, 95th percentile as the value at index 0.95 (n - 1) cut to a whole, and extremes; df is read once, to count its values."""
    counts = value_counts(df, by, value)
    places = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2), "p95": lambda n: F.floor(0.95 * (n - 1))}
    at = counted_at(counts, by, places).select(*by, "n", F.floor((F.col("_low") + F.col("_high")) / 2).alias("median"), "p95")
    mean = F.sum(F.col("_v").cast("double") * F.col("_c")) / F.sum("_c")
    return counts.groupBy(*by).agg(F.round(mean, DIGITS).alias("mean"), F.min("_v").alias("least"), F.max("_v").alias("most")).join(at, by)


def threshold_sweep(tokens: DataFrame, thresholds: list[int]) -> DataFrame:
    """(set, labelled, tokens) -> N1, N2 and N3 counts by set, labelled and threshold, from a histogram."""
    spark = tokens.sparkSession
    histogram = tokens.groupBy("set", "labelled", "tokens").agg(F.count("*").alias("n"))
    grid = F.broadcast(spark.createDataFrame([(t,) for t in thresholds], "threshold int"))
    rows = histogram.join(grid)  # the histogram and the grid are both small
    pick = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    some = F.col("tokens") > 0
    return rows.groupBy("set", "labelled", "threshold").agg(pick(F.col("tokens") >= F.col("threshold")).alias("n1"), pick(some & (F.col("tokens") < F.col("threshold"))).alias("n2"), pick(~some).alias("n3"))


def swap_feasibility(df: DataFrame, stratum: str, patient: str) -> DataFrame:
    """By stratum: rows, patients, the largest patient's rows, and whether every row can get another patient's context."""
    per = df.groupBy(stratum, patient).agg(F.count("*").alias("n"))
    return per.groupBy(stratum).agg(F.sum("n").alias("rows"), F.count("*").alias("patients"), F.max("n").alias("largest"), ((F.count("*") >= 2) & (F.max("n") <= F.sum("n") - F.max("n"))).alias("feasible"))
