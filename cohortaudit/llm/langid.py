"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has a word of 64 language bits in each slot. An n-gram's slots
and-ed give all languages whose n-grams hold it (and a few false ones). A document's
n-grams are looked up, the bits of each language counted, the counts corrected by the
language's rate of false positives, and the highest decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortaudit.llm.common import hash_bound, keep_rows, map_rows, stage

#: The model's size: training documents for each language (in expectation), n-grams that a
#: language's filter learns at most (the commonest), slots of the filter. Each 64 languages
#: take 8 bytes a slot.
PER_LANGUAGE, GRAMS = 1500, 40_000
LOG_SLOTS = 20
UNKNOWN = "und"
_CHUNK = 4 << 20
_TABLE = bytes(b if b >= 128 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B)


def grams(text: str | None) -> np.ndarray:
    """Codes of the text's runs of four bytes, lower-cased, with a blank for each stretch of other characters than letters."""
    raw = np.frombuffer(b" " + (text or "").lower().encode().translate(_TABLE) + b" ", np.uint8)
    blank = raw == 32
    raw = raw[np.concatenate(([True], ~(blank[1:] & blank[:-1])))].astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(0, np.uint32)
    return raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]


def _slot(codes: np.ndarray, k: int) -> np.ndarray:
    return (codes * np.uint32(_MULTIPLIERS[k])) >> np.uint32(32 - LOG_SLOTS)


class Filters:
    """The filter of all languages: slots x words of 64 language bits."""

    def __init__(self, languages: list[str], fallback: str):
        self.languages, self.fallback = languages, fallback
        self.bits = np.zeros((1 << LOG_SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
        self.false_rate = np.zeros(len(languages))

    def add(self, language: int, codes: np.ndarray) -> None:
        bit = np.uint64(1 << (language % 64))
        for k in range(len(_MULTIPLIERS)):
            self.bits[np.unique(_slot(codes, k)), language // 64] |= bit
        full = (self.bits[:, language // 64] & bit != 0).mean()
        self.false_rate[language] = full ** len(_MULTIPLIERS)

    def languages_of(self, codes: np.ndarray) -> np.ndarray:
        """The language bits of each n-gram."""
        return self.bits[_slot(codes, 0)] & self.bits[_slot(codes, 1)]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        counts, total = np.zeros(len(self.languages), np.int64), 0
        codes = grams(text)
        for at in range(0, len(codes), _CHUNK):
            masks = self.languages_of(codes[at : at + _CHUNK])
            total += len(masks)
            counts += [np.count_nonzero(masks[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(counts))]
        if not total:
            return self.fallback, 0.0
        share = (counts / total - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        best = int(share.argmax())
        return (self.languages[best], float(min(1.0, share[best]))) if share[best] > 0 else (self.fallback, 0.0)


def held_out(id_column) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, keep: int = GRAMS) -> Filters:
    """Filters from documents that are not held out and have a language.

    The sample holds about `per_language` documents of each language, those of the
    smallest hashes of (id, text length); an n-gram counts for a language if at least
    two of its sample's documents, or a thousandth of per_language, hold it; where over
    `keep` n-grams do, the bar is raised to the first number of documents at which at
    most `keep` are left.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row for each language
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    filters = Filters(languages, min(sizes, key=lambda x: (-sizes[x], x)) if sizes else UNKNOWN)
    if not languages:
        return filters
    spark = docs.sparkSession
    rates = spark.createDataFrame([(x, i, hash_bound(per_language / sizes[x])) for i, x in enumerate(languages)], "lang string, language int, bound long")
    sample = rows.join(F.broadcast(rates), "lang").where(F.xxhash64("doc_id", F.length("text")) <= F.col("bound")).select("language", "text")

    def count(batches):
        for language, texts in batches:
            own: dict[int, list[np.ndarray]] = {}
            for i, t in zip(language, texts):
                own.setdefault(i, []).append(np.unique(grams(t)))
            for i, parts in own.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield [[i] * len(code), code.tolist(), n.tolist()]

    counts = map_rows(sample, count, "language int, code long, n long").groupBy("language", "code").agg(F.sum("n").alias("n"))
    counts, _ = stage(counts, "grams")
    least = dict.fromkeys(range(len(languages)), max(2, per_language // 1000))
    held = dict.fromkeys(least, 0)
    # how many n-grams have each count: a row for each language and count
    for r in counts.groupBy("language", "n").agg(F.count("*").alias("grams")).orderBy(F.desc("n")).collect():
        held[r.language] += r.grams
        if held[r.language] > keep:
            least[r.language] = max(least[r.language], r.n + 1)
    bars = spark.createDataFrame(sorted(least.items()), "language int, least long")
    found = counts.join(F.broadcast(bars), "language").where(F.col("n") >= F.col("least")).select("language", "code").toPandas()
    for i, own in found.groupby("language"):
        filters.add(int(i), own.code.to_numpy(np.uint32))
    return filters


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out boolean, lang_pred string, score double), a row for each row of docs.

    `und` with score 0 where the text is null, empty or has no letter, or where nothing
    was learned; a text too short for an n-gram, or of none that was learned, gets the
    language with most training documents and score 0. Ties go to the language first in
    order. Repeated rows stay, a null doc_id is not held out, other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def rows(batches):
        for ids, held, texts in batches:
            found = [shared.value.predict(t) for t in texts]
            yield [ids, held, [x for x, _ in found], [s for _, s in found]]

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(held, rows, "doc_id long, held_out boolean, lang_pred string, score double")


def in_language(docs: DataFrame, filters: Filters, least: float, text_col: str = "text") -> DataFrame:
    """docs' rows, with all their columns, whose language identify() would know with a score of `least` or more.

    The rows are judged where they lie, so nothing is joined and ids don't matter: they
    may be null or repeat. Null and empty texts and those without letters go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    return keep_rows(docs, text_col, lambda texts: [x != UNKNOWN and s >= least for x, s in map(shared.value.predict, texts)])
