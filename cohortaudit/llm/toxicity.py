"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade >= k) = sigmoid(w x - t_k): the weights w are shared by all thresholds, and the
thresholds are ordered. Trained from a bounded sample of labelled documents; the score
of a document is its expected grade.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortaudit.llm.common import hash_bound, map_rows, words_of

#: Labelled documents of each label in the sample (in expectation), features, grades.
PER_LABEL, FEATURES, GRADES = 3000, 2000, 4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Words with weights, and ordered thresholds between the grades."""

    def __init__(self, words: list[bytes], weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.index = {w: i for i, w in enumerate(words)}

    def features(self, text: str | None) -> dict[int, float]:
        index = self.index
        counts = Counter(i for i in map(index.get, words_of(text)) if i is not None)
        return {i: float(np.log1p(n)) for i, n in counts.items()}

    def at_least(self, text: str | None) -> np.ndarray:
        """The chances of grade 1 or more, 2 or more, ..."""
        score = sum(self.weights[i] * x for i, x in self.features(text).items())
        return _sigmoid(score - self.thresholds)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, l2: float = 1e-4, steps: int = 800, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by maximum likelihood with Adam.

    The thresholds are a first one and positive steps (exp of free values), so they stay
    ordered. Grade 0 and all others weigh the same together. Deterministic.
    """
    n, d = x.shape
    share = np.where(grade == 0, 0.5 / max(1, (grade == 0).sum()), 0.5 / max(1, (grade > 0).sum()))
    w, free = np.zeros(d), np.concatenate(([1.0], np.zeros(max(0, grades - 2))))
    m, v = np.zeros(d + len(free)), np.zeros(d + len(free))
    rows = np.arange(n)
    for step in range(1, steps + 1):
        t = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
        above = _sigmoid((x @ w)[:, None] - t)
        edges = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        p = np.maximum(edges[rows, grade] - edges[rows, grade + 1], 1e-9)
        slope = np.concatenate((np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))), axis=1)
        by_score = -(slope[rows, grade] - slope[rows, grade + 1]) / p * share
        by_t = np.zeros((n, grades + 1))
        by_t[rows, grade] += slope[rows, grade] / p * share
        by_t[rows, grade + 1] -= slope[rows, grade + 1] / p * share
        dt = by_t[:, 1:grades].sum(axis=0)
        down = np.concatenate((x.T @ by_score + l2 * w, [dt.sum()], np.exp(free[1:]) * np.cumsum(dt[::-1])[::-1][1:]))
        m, v = 0.9 * m + 0.1 * down, 0.999 * v + 0.001 * down**2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= change[:d]
        free -= change[d:]
    return w, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> DataFrame:
    """(digest, toxic int, text): about per_label documents of each label, twice as many at most, each text once."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bound = F.lit(hash_bound(0.0))
    for k, n in sizes.items():
        bound = F.when(F.col("toxic") == k, F.lit(hash_bound(per_label / n))).otherwise(bound)
    chosen = known.where(F.xxhash64("_id") <= bound)
    # at most about 2 * per_label rows, so the texts need no shuffle
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("toxic", "text")
    distinct = rows.groupBy(F.md5("text").alias("digest")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("digest", "toxic", "text")
    # an id that many rows share may bring many texts; those of the smallest digests stay
    first = [distinct.where(F.col("toxic") == k).orderBy("digest").limit(2 * per_label) for k in (0, 1)]
    return first[0].unionByName(first[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL, features: int = FEATURES, grades: int = GRADES) -> OrdinalModel:
    """Fit the model from documents with a label of 0 or 1.

    The features are words that are in at least five sampled documents and whose shares
    among toxic and other documents differ by four standard errors. Where the label is
    0 the grade is 0; toxic documents get grades 1, 2, ... by equal shares of how
    much they hold of the words that lean to toxic (the sum of log(1 + count)). Without documents of both labels the model
    gives every document grade 0.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col, per_label)

    def words(batches):
        for toxic, texts in batches:
            n = Counter((t, w) for t, text in zip(toxic, texts) for w in set(words_of(text)))
            if n:
                yield [[w.decode() for _, w in n], [t for t, _ in n], list(n.values())]

    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return OrdinalModel([], np.zeros(0), np.full(grades - 1, 40.0))
    counts = map_rows(sample.select("toxic", "text"), words, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")).where("a + b >= 5")
    n1, n0 = float(sizes[1]), float(sizes[0])
    pooled = (F.col("a") + F.col("b")) / (n1 + n0)
    z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    chosen = counts.withColumn("z", z).where(F.abs("z") >= 4).orderBy(F.desc(F.abs("z")), "word").limit(features).collect()
    vocabulary = [r.word.encode() for r in chosen]
    leaning = {i for i, r in enumerate(chosen) if r.z > 0}
    probe = OrdinalModel(vocabulary, np.zeros(len(vocabulary)), np.zeros(grades - 1))

    def rows(batches):
        for digest, toxic, texts in batches:
            found = [probe.features(t) for t in texts]
            yield [digest, toxic, [list(f) for f in found], [list(f.values()) for f in found]]

    data = sorted(map_rows(sample, rows, "digest string, toxic int, at array<int>, x array<double>").collect())
    x = np.zeros((len(data), len(vocabulary)))
    toxic, amount = np.array([r.toxic for r in data]), np.zeros(len(data))
    for k, r in enumerate(data):
        x[k, r.at] = r.x
        amount[k] = sum(v for i, v in zip(r.at, r.x) if i in leaning)
    cuts = np.quantile(amount[toxic == 1], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, amount, "left"), 0)
    weights, thresholds = fit_ordinal(x, grade, grades)
    return OrdinalModel(vocabulary, weights, thresholds)


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxic boolean, grade int, expected_severity double, chance double), a row for each row of docs.

    chance is that of grade 1 or more, toxic whether it is 0.5 or more, grade the most
    likely one (ties: the lower). Null and empty texts hold no word and are scored by
    the thresholds alone. Repeated rows stay, other columns are not read.
    """
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for ids, texts in batches:
            p = np.array([shared.value.at_least(t) for t in texts])
            each = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1), axis=1)
            yield [ids, (p[:, 0] >= 0.5).tolist(), each.argmax(axis=1).tolist(), p.sum(axis=1).tolist(), p[:, 0].tolist()]

    return map_rows(rows_in, rows, "doc_id long, toxic boolean, grade int, expected_severity double, chance double")
