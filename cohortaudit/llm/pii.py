"""Personal data: generators propose overlapping spans, boosted trees and calibrated thresholds select.

Four base kinds are reported wherever their rules hold. Further generators propose
spans with high recall; gradient-boosted trees read the span's format and its context,
and a threshold for each kind, calibrated for precision, decides. All of it is DataFrame
operations and ml: a text is split at a generator's matches, and running sums of the
pieces' lengths are the places of the matches.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortaudit.llm import labelled_private
from cohortaudit.llm.common import project, stage

#: All kinds in the order in which spans are listed, each with its generator; the first four are the base.
# Possessive repeats and lookbehinds only keep the patterns linear: a run is entered at its
# first character or (\G) where the match before it ended.
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole sequences of 16 to 19 digits; shorter and longer ones fail whatever they hold
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[]\x20?[Aa][Tt]\x20?[)\]]\x20?|\x20[Aa][Tt]\x20)[A-Za-z0-9-]++(?:(?:\x20?[(\[]\x20?[Dd][Oo][Tt]\x20?[)\]]\x20?|\x20[Dd][Oo][Tt]\x20|\.)[A-Za-z0-9-]++)++",
    "ip6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{0,4}+(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}(?:\x20?(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}(?:\x20?[0-9][A-Z0-9]{0,2})?(?![A-Za-z0-9])",
    "number": r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
    "identity": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{0,2}[0-9]{6,9}[A-Z]?)(?![0-9A-Za-z-])",
    "birth": r"(?<![0-9A-Za-z./-])[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}(?![0-9A-Za-z]|[./-][0-9])",
    "handle": r"(?<![A-Za-z0-9_@./+-])@[A-Za-z0-9_]{3,30}+(?![A-Za-z0-9_@])",
}
KINDS = tuple(GENERATORS)
BASE = 4
#: What a text needs for a generator to be tried at all.
NEEDS = {"email": "@", "phone": "+", "handle": "@", "ip6": ":"}
#: Code points of context that the trees see on each side.
LEFT, RIGHT = 40, 16
#: Words before (and after) a span, lower-cased, that speak for a kind or against all of them.
CUES = {
    "phone": r"\b(?:tel|phone|telephone|telefon|t[eé]l[eé]phone|tel[eé]fono|call|mobile|cell|fax|handy|ring|dial|whatsapp|text me|number is|appelez|llame)\b",
    "mail": r"\b(?:mail|e-mail|email|contact|kontakt|write|reach|schreiben|escriba|correo|message|address|send|ask|via)\b",
    "bank": r"\b(?:iban|bic|bank|account|konto|kontonummer|cuenta|compte|transfer|pay|paid|refund|virement|bankverbindung)\b|überweisung",
    "identity": r"\b(?:ssn|social|s[eé]curit[eé]|passport|pasaporte|reisepass|passeport|ausweis|dni|nif|national id|identity|taxpayer|steuer-id|licence|license)\b",
    "birth": r"\b(?:born|birth|birthday|dob|geboren|geburtsdatum|geb|n[eé]e?|nacid[oa]|nacimiento|naissance|b)\b",
    "network": r"\b(?:ip|ipv6|host|client|peer|login|logged|from|by|source|visitor|address|adresse|ping|user|assigned)\b",
    "social": r"\b(?:follow|twitter|instagram|telegram|via|tweet|thanks|dm|photo|ping|cc|as|profile|s[ií]gueme|folgt)\b",
    "thing": r"\b(?:isbn|issn|doi|order|invoice|version|pages?|part|model|serial|ticket|case|patent|grant|build|code|katalog|catalogue|item|article|artikel|ref|r[eé]f|lot|release|population|sum|tracking|product|room|flight|batch|route|log)\b",
}
#: Phrases' values, boosting rounds and depth, and the precision that a threshold has to reach.
EACH, ROUNDS, DEPTH, PRECISION = 8, 12, 4, 0.95


def _hits(kind: str, text: Column) -> Column:
    """For each piece between matches: its length, both its ends, and the match that follows it (null after the last)."""
    pattern = F.lit(GENERATORS[kind])
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    cut = F.zip_with(pieces, found, lambda p, m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(p).alias("before"), F.right(p, F.lit(LEFT)).alias("left"), F.left(p, F.lit(RIGHT)).alias("head"), m.alias("match")))
    tried = F.rlike(text, pattern)
    return F.when(F.contains(text, F.lit(NEEDS[kind])) & tried if kind in NEEDS else tried, cut)


def _scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hits): docs(row, doc_id, text) with the hits of all generators; null where there is none."""
    hits = F.array_compact(F.array(*(_hits(k, F.col("text")) for k in KINDS)))
    return docs.select("row", "doc_id", F.flatten(hits).alias("hits"))


def _placed(found: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, match, left, right): the candidates of every row that has hits.

    Each row's hits go to one task in their order; a row is one text, and what is dealt
    are its hits and their contexts.
    """
    rows = found.where(F.size("hits") > 0).select("row", "doc_id", F.posexplode("hits").alias("at", "h")).select("row", "doc_id", "at", "h.*").repartition("row")
    ordered = Window.partitionBy("row", "kind").orderBy("at")
    size = F.coalesce(F.length("match"), F.lit(0))
    start = F.sum(F.col("before").cast("long") + size).over(ordered) - size
    placed = rows.select("row", "doc_id", "kind", start.alias("start"), (start + size).alias("end"), "match", "left", F.lead("head").over(ordered).alias("right"))
    return placed.where("match is not null")


def _holds(kind: Column, match: Column) -> Column:
    """Whether a candidate is a base span."""
    part, digits = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])", F.regexp_replace(match, "[^0-9]", "")
    holds = {
        "email": F.lit(True),
        "ip": F.rlike(match, F.lit(rf"^{part}\.{part}\.{part}\.{part}$")),
        "card": F.length(digits).between(16, 19) & F.expr("luhn_check(regexp_replace(match, '[^0-9]', ''))"),
        "phone": F.length(digits).between(8, 15),
    }
    return reduce(lambda out, k: F.when(kind == KINDS.index(k), holds[k]).otherwise(out), KINDS[:BASE], F.lit(False))


def _checksum(match: Column) -> Column:
    """Whether letters and digits, the first four put last, leave 1 when divided by 97."""
    plain = F.regexp_replace(match, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    letter = lambda c: F.ascii(c) - 55
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(F.rlike(c, F.lit("^[A-Z]$")), F.pmod(a * 100 + letter(c), F.lit(97))).when(F.rlike(c, F.lit("^[0-9]$")), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(a))
    return (F.length(plain) >= 15) & (rest == 1)


def _features() -> dict[str, Column]:
    """Format and context of a candidate, all as doubles."""
    match, kind, left, right = F.col("match"), F.col("kind"), F.lower(F.coalesce("left", F.lit(""))), F.lower(F.coalesce("right", F.lit("")))
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = lambda pattern: F.regexp_count(match, F.lit(pattern))
    year = F.regexp_extract(match, r"(?:^|[./-])([0-9]{4})(?:$|[./-])", 1)
    found = {f"is_{k}": kind == i for i, k in enumerate(KINDS) if i >= BASE}
    found |= {f"cue_{k}": F.rlike(left, F.lit(p)) for k, p in CUES.items()}
    found |= {
        "digits": F.length(digits), "chars": F.length(match), "groups": count("[0-9]+"), "letters": count("[A-Za-z]"),
        "dashes": count("-"), "dots": count(r"\."), "colons": count(":"), "slashes": count("/"), "spaces": count(r"\x20"), "brackets": count(r"[(\[]"),
        "zero_first": match.startswith("0"), "bracket_first": match.startswith("("), "double_colon": F.contains(match, F.lit("::")),
        "dot_word": F.rlike(match, F.lit(r"(?i)\bdot\b")), "bracket_at": F.rlike(match, F.lit(r"(?i)[(\[]\x20?at")), "hex_letters": F.rlike(match, F.lit("[a-f]")),
        "checksum": (kind == KINDS.index("iban")) & _checksum(match),
        "year": F.when(F.length(year) == 4, year.cast("double")).otherwise(0.0),
        "isbn_first": F.rlike(match, F.lit("^97[89]")), "doi_first": match.startswith("10."),
        "thing_after": F.rlike(right, F.lit(r"^[^a-z]*(?:euros?|units|kg|km|pages|class|public|static|screen|def|int|x the|name)\b")),
        "newline_before": F.rlike(left, F.lit(r"\n\s*$")), "bare": left == "",
    }
    return {k: v.cast("double") for k, v in found.items()}


def _assembled(candidates: DataFrame) -> DataFrame:
    features = _features()
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(candidates.select("*", *(v.alias(k) for k, v in features.items()))).drop(*features)


@dataclass
class PiiModel:
    """Boosted trees and, by kind, the least probability that selects a span."""

    trees: GBTClassificationModel
    thresholds: dict[str, float] = field(default_factory=dict)

    def scored(self, candidates: DataFrame) -> DataFrame:
        """candidates with probability and chosen, for the kinds that the trees judge."""
        done = self.trees.transform(_assembled(candidates)).withColumn("probability", vector_to_array("probability")[1])
        least = reduce(lambda out, k: F.when(F.col("kind") == KINDS.index(k), F.lit(self.thresholds[k])).otherwise(out), self.thresholds, F.lit(2.0))
        return done.withColumn("chosen", F.col("probability") >= least).drop("features", "rawPrediction", "prediction")


def labelled_spans(spark: SparkSession, each: int = EACH) -> DataFrame:
    """(id, text, kind, start, end, personal, split): the small labelled table."""
    return spark.createDataFrame(labelled_private.rows(each), "id long, text string, kind string, start long, end long, personal int, split string")


def labelled_candidates(table: DataFrame) -> DataFrame:
    """What the generators propose in a labelled table's texts, with label 1 where a candidate of a row's kind meets its personal span."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    placed = _placed(_scan(table.select(F.col("id").alias("row"), F.col("id").alias("doc_id"), "text"))).where(F.col("kind") >= BASE)
    known = table.select(F.col("id").alias("row"), (F.array_position(kinds, F.col("kind")) - 1).alias("own"), F.col("start").alias("low"), F.col("end").alias("high"), "personal", "split")
    met = (F.col("kind") == F.col("own")) & (F.col("start") < F.col("high")) & (F.col("end") > F.col("low"))
    return placed.join(known, "row").withColumn("label", F.when(met, F.col("personal")).otherwise(0).cast("double"))


def train(table: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, precision: float = PRECISION) -> PiiModel:
    """Fit the trees on the split `train` and set each kind's threshold on `calibrate`.

    A threshold is the least probability, 0.5 or more, at which the candidates at or above
    it reach the precision; a kind for which there is none selects nothing. The table is
    a bounded one of labelled texts with candidates of both labels in `train`.
    """
    rows, _ = stage(labelled_candidates(table), "labelled")
    fit_on = _assembled(rows.where("split = 'train'")).select("features", "label").repartition(1)
    model = PiiModel(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1).fit(fit_on))
    scored = model.scored(rows.where("split = 'calibrate'"))
    reached = scored.withColumn("precision", F.avg("label").over(Window.partitionBy("kind").orderBy(F.desc("probability"))))
    # a row for each kind
    for r in reached.where((F.col("precision") >= precision) & (F.col("probability") >= 0.5)).groupBy("kind").agg(F.min("probability").alias("least")).collect():
        model.thresholds[KINDS[r.kind]] = r.least
    return model


def _selected(candidates: DataFrame) -> DataFrame:
    """candidates with kept: base spans, and chosen ones that meet no base span; of chosen ones that overlap, directly or by way of others, the likeliest (then the first, then the longest)."""
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.when(F.col("base"), F.col(c))
    near = candidates.withColumn("last", F.max(base("end")).over(before)).withColumn("next", F.min(base("start")).over(after))
    free = F.coalesce(F.col("last") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    judged = near.withColumn("free", ~F.col("base") & F.col("chosen") & free).drop("last", "next", "chosen")
    # runs of overlapping spans; only free ones open or prolong a run
    reach = F.max(F.when(F.col("free"), F.col("end"))).over(Window.partitionBy("row", "free").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1))
    opened = judged.withColumn("opens", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    run = F.sum("opens").over(Window.partitionBy("row", "free").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy("row", "free", "run").orderBy(F.desc("probability"), "start", F.desc("end"), "kind"))
    return opened.withColumn("run", run).withColumn("place", place).withColumn("kept", F.col("base") | (F.col("free") & (F.col("place") == 1)))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_private(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    spans lists kind:start:end by kind in the order of KINDS, then start; found holds the
    same as structs (kind, start, end), kind an index of KINDS. The counts and base_sha256
    are those of the four base kinds. Null and empty texts have no spans; repeated rows
    stay; a null doc_id stays null; no rows give none; other columns are not read.
    """
    numbered = project(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    # written, so that a row keeps its number whichever task reads it again
    found, _ = stage(_scan(numbered), "private")
    candidates = _placed(found).withColumn("base", _holds(F.col("kind"), F.col("match")))
    scored = _selected(model.scored(candidates))
    span = F.struct("kind", "start", "end")
    lists = scored.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("found"))
    none = found.where(F.coalesce(F.size("hits"), F.lit(0)) <= 0).select("row", "doc_id", F.lit(None).cast(lists.schema["found"].dataType).alias("found"))
    every = lists.unionByName(none).withColumn("found", F.coalesce("found", F.array().cast(lists.schema["found"].dataType)))
    # a second parameter of the function would be the position, so the kind comes from a closure
    of_kind = lambda k: F.filter("found", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    base = F.filter("found", lambda s: s["kind"] < BASE)
    return every.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), "found")
