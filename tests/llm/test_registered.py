"""The registered queries on whole given tables against brute force or their SQL."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortaudit.llm import queries, tokens
from test_llm_operators import brute_components, brute_secrets, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.sql(f"create view {p.stem} as select * from '{f'{p}/*.parquet' if p.is_dir() else p}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.sql("select doc_id, text from documents").fetchall()}


def ids_of(text, end):
    library = Tokenizer.from_file(tokens.vocabulary())
    return np.array([*library.encode(text, add_special_tokens=False).ids, end], "<u4")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def test_secrets(spark, texts):
    got = queries.op1_secrets(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = brute_secrets(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        listed = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))


def test_url_filter(spark, duck):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    pages = dict(duck.sql("select page_id, url from pages").fetchall())
    got = queries.op2_url_filter(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        _, there, rest = (pages[r.page_id] or "").partition("://")
        host = "".join(c.lower() if c.isascii() else c for c in re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        fit = [k for k in rules if f".{host}".endswith("." + k.split("/")[0]) and path.startswith(k[k.index("/") :])]
        want = max(fit, key=len) if fit else None
        assert (r.host, r.path, r.rule) == (host, path, want)
        assert r.verdict == rules.get(want, "block" if r.score >= 0.5 else "allow")


def test_token_store(spark, texts):
    got, start = {r.doc_id: r for r in queries.op3_token_store(spark, SF).collect()}, 0
    assert sorted(got) == sorted(texts)
    for i in sorted(texts):
        ids = ids_of(texts[i], 1)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in found.fetchall())))


def test_toxicity(spark, texts):
    got = queries.op5_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.toxic == (r.chance >= 0.5) and 0 <= r.chance <= r.expected_severity <= 3 * r.chance + 1e-9 for r in got)


def test_simhash(spark, texts):
    got = queries.op6_simhash(spark, SF).collect()
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = brute_components(prints, 2)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{x:016x}", want[i]) for i, x in prints.items())


def test_licenses(spark, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = queries.op7_licenses(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        words = words_of(texts[r.doc_id])
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        base = {label for _, label in places}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) | (set() if base else {""}) and 0 <= r.score <= 1


def test_packing(spark, texts):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op9_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert sorted(pieces) == sorted(texts)
    for i, rows in pieces.items():
        ids, at = ids_of(texts[i], 2), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.05 * sum(r.length for rows in pieces.values() for r in rows)


def test_language(spark, texts, duck):
    known = dict(duck.sql("select doc_id, lang from documents").fetchall())
    got = queries.op10_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    learned = {known[i] for i in known if known[i] and zlib.crc32(str(i).encode()) % 4 != 2}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id])) and 0 <= r.score <= 1
        assert r.lang_pred == "und" or r.lang_pred in learned
    held = [r.lang_pred == known[r.doc_id] for r in got if r.held_out and known[r.doc_id]]
    assert sum(held) >= 0.9 * len(held)
