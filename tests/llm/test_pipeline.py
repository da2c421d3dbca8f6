"""The pipeline's stages against brute force on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortaudit.llm import simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "packing"]


def test_language_stage_drops_only_what_it_rejects(spark, docs):
    odd = docs.limit(0).union(spark.createDataFrame([(9001, "123 456", "en", "s", 7), (9002, None, "en", "s", 0), (9001, docs.first().text, "en", "s", 1)], docs.schema))
    got = corpus_pipeline.language(spark, docs.union(odd), SF)
    assert got.columns == docs.columns
    assert got.count() == docs.count() + 1


def test_dedup_keeps_one_of_each_group(spark, docs):
    twice = docs.union(docs.limit(5)).union(docs.limit(3).selectExpr("doc_id + 100000", "text", "lang", "source", "n_chars"))
    got = corpus_pipeline.near_dedup(spark, twice, SF)
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and max(ids) < 100000
    groups = {r.component_id for r in simhash.copies(docs).collect()}
    assert set(ids) == groups


def test_decontamination_and_secrets(spark, docs):
    from cohortaudit.llm import decontaminate, secrets

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
    got = corpus_pipeline.decontamination(spark, docs, SF)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} - bad
    clean = corpus_pipeline.secret_scan(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert secrets.find_secrets(clean).where("n_assign + n_access + n_hex > 0").count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0


def test_judged_where_they_lie(spark, docs):
    """Rows that share an id are judged by their own texts, several benchmark blocks act as one, and no plan moves texts."""
    from cohortaudit.llm import decontaminate, langid

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one_id = docs.withColumn("doc_id", F.lit(5).cast("long"))
    filters = langid.train(docs)
    said = langid.identify(docs, filters).where(F.col("lang_pred") != "und").where(f"score >= {corpus_pipeline.MIN_LANGUAGE_SCORE}").select("doc_id")
    texts = lambda df: sorted(r.text or "" for r in df.collect())
    assert texts(langid.in_language(one_id, filters, corpus_pipeline.MIN_LANGUAGE_SCORE)) == texts(docs.join(said, "doc_id"))
    clean = decontaminate.contamination(docs, bench).where("not contaminated").select("doc_id")
    assert 0 < clean.count() < docs.count()
    for chars in (decontaminate.BLOCK_CHARS, 3000):
        assert texts(decontaminate.clean(one_id, bench, block_chars=chars)) == texts(docs.join(clean, "doc_id"))
    for step in (corpus_pipeline.language, corpus_pipeline.decontamination):
        plan = step(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_run(spark, docs):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    totals = got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert totals and all(r["sum(length)"] == r["max(doc_tokens)"] for r in totals)
    sizes = [r["sum(length)"] for r in got.groupBy("sequence_id").sum("length").collect()]
    assert all(n == 4096 or n.bit_count() == 1 for n in sizes)


def jaccard_components(texts):
    """The smallest index that links of a five-word similarity of 0.8 or more reach, all pairs compared."""
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if root[i] != root[j] and (both * 5 >= (len(a) + len(sets[j]) - both) * 4):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_copies_equal_all_pairs(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    want = jaccard_components([r.text for r in rows])
    got = {r.doc_id: r.component_id for r in simhash.copies(docs).collect()}
    assert [got[r.doc_id] for r in rows] == [rows[k].doc_id for k in want]
    assert len(set(want)) < len(want)


@pytest.mark.parametrize(("tile", "block"), [(simhash.SHINGLES, simhash.TILE), (3000, 12)])
def test_recall_of_planted_copies(spark, monkeypatch, tile, block):
    """Copies at similarities from just over 0.8 on, in pairs and in one large group, with a line that all texts share; with small tiles too."""
    monkeypatch.setattr(simhash, "TILE", block)
    monkeypatch.setattr(simhash.links, "__defaults__", (2, 1, block))
    monkeypatch.setattr(simhash._linked, "__defaults__", (1, block))
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(50_000)}"
    line = " ".join(f"line{i}" for i in range(30))
    texts, pairs = [], []
    for k in range(120):
        words = [word() for _ in range(rng.randrange(60, 300))]
        near = list(words)
        share = (0.81, 0.85, 0.9, 0.95)[k % 4]
        n = len(words) - 4 + 30  # shingles, changes at the end take one each
        for i in range(int(n * (1 - share) / (1 + share))):
            near[-1 - i] = word()
        pairs.append((len(texts), len(texts) + 1))
        texts += [f"{line} {' '.join(words)}", f"{line} {' '.join(near)}"]
    base = [word() for _ in range(150)]
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    want = jaccard_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.copies(docs, tile=tile).collect()}
    assert sum(want[a] == want[b] for a, b in pairs) == len(pairs)
    assert [got[i] for i in range(len(texts))] == want


def test_odd_tables(spark, docs):
    """Clashing names, null ids and texts, repeated and long rows, and an empty table, through every stage."""
    names = ("key", "sign", "row", "found", "_found", "id", "n", "component_id", "span_id", "size", "node", "hash")
    long = "a long text of words " * 100_000
    odd = docs.limit(0).union(spark.createDataFrame([(None, "the and of that with", "en", "s", 5), (None, None, None, None, None), (7, None, "en", None, 0), (7, "", "en", "s", 0), (9001, long, "en", "s", len(long)), (9001, long, "en", "s", len(long))], docs.schema))
    wide = docs.union(odd).withColumns({c: F.lit(c) for c in names})
    for rows in (wide, wide.limit(0)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            got = step(spark, rows, SF)
            assert got.columns == wide.columns, name
            assert got.count() <= rows.count()
        packed = corpus_pipeline.packed(spark, rows, SF)
        assert packed.select("doc_id", "doc_tokens").where("doc_id = 9001").distinct().count() == (1 if rows is wide else 0)
    kept = corpus_pipeline.near_dedup(spark, wide, SF)
    assert kept.where("doc_id = 9001").count() == 1
    assert kept.where("doc_id is null and text is not null").count() == 1
