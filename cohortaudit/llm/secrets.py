"""Secret scans: credential patterns, and weak parts linked where complementary ones meet.

Three strong kinds are reported wherever they match. Weak parts (account names, tokens
that look random, endpoints) are reported only where a secret lies together with an
identifier or an endpoint: each secret-like part opens a scope around itself, inside its
block of lines, and an interval join finds the identifiers and endpoints in the scopes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortaudit.llm.common import BATCH_ROWS, LOWER_TABLE, SMALL_SIDE, map_rows, project, sliced, stage

#: All kinds in the order in which spans that start together are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SECRETS, PARTNERS = {"assign", "hex", "secret"}, {"access", "identifier", "endpoint"}
#: Characters around a secret in which its other parts are looked for.
RADIUS = 300
BIN = 1024
MASK = "[secret]"
#: What is masked unless told otherwise: account names and endpoints stay in the text.
MASKED = ("assign", "access", "hex", "secret")

# on bytes with A-Z lower-cased
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_IDENTIFIER = re.compile(rb"(?:user(?:name)?|login|account|client_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9_.@+-]{3,}")
_ENDPOINT = re.compile(rb"[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]+")
_RANDOM = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_BREAK = re.compile(rb"\n[\x20\t\r]*\n")


def _entropy(token: bytes) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _looks_random(token: bytes) -> bool:
    """Upper- and lower-case letters and digits together, at 3.5 bits a character or more."""
    return bool(re.search(rb"[0-9]", token) and re.search(rb"[A-Z]", token) and re.search(rb"[a-z]", token)) and _entropy(token) >= 3.5


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _meets(united: list[tuple[int, int]], start: int, end: int) -> bool:
    at = bisect_left(united, (end,))
    return at > 0 and united[at - 1][1] > start


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """(strong spans, parts): spans are (start, kind, end) in code points, kind an index of KINDS.

    Parts are (start, kind, end, scope start, scope end), scopes only on secret-like
    ones; parts are left out where the text lacks one of the two sides.
    """
    if not text:
        return [], []
    raw = text.encode()
    low = raw.translate(LOWER_TABLE)
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 6]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw)] if b"AKIA" in raw else []
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw)]
    weak = [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(low)]
    weak += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(low)] if b"://" in low else []
    random = [m for m in _RANDOM.finditer(raw) if _looks_random(m.group())]
    taken = _united([(a, b) for a, _, b in spans + weak]) if random else []
    weak += [(m.start(), 4, m.end()) for m in random if not _meets(taken, m.start(), m.end())]
    parts = sorted(spans + weak)
    if len({KINDS[k] in SECRETS for _, k, _ in parts}) < 2:
        parts = []
    if len(raw) != len(text) and (spans or parts):
        point = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    else:
        point = range(len(raw) + 1)
    breaks = np.array([m.end() for m in _BREAK.finditer(raw)] if parts else [], np.int64)
    placed = []
    for a, k, b in parts:
        start, end, low, high = int(point[a]), int(point[b]), None, None
        if KINDS[k] in SECRETS:
            at = np.searchsorted(breaks, a, "right")
            low = max(int(point[breaks[at - 1]]) if at else 0, start - RADIUS)
            high = min(int(point[breaks[at]]) if at < len(breaks) else len(text), end + RADIUS)
        placed.append((start, k, end, low, high))
    return sorted((int(point[a]), k, int(point[b])) for a, k, b in spans), placed


_SPANS = "array<struct<start: long, kind: int, end: long>>"


def _named(column) -> F.Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _linked(found: DataFrame) -> DataFrame:
    """(row, linked): the weak parts in scopes where complementary parts meet.

    A scope and a partner meet where they overlap. Both lie in the bins of BIN code points
    that they cover, and a pair counts in the first bin that it shares, so the join is by
    (row, bin). Parts of a kind don't overlap and have a least length, which bounds the
    partners of a scope by its length, whatever the document's.
    """
    parts = found.where(F.size("parts") > 0).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    kinds = {k: i for i, k in enumerate(KINDS)}
    is_secret = F.col("kind").isin([kinds[k] for k in sorted(SECRETS)])
    scopes = parts.where(is_secret).select("row", F.struct("start", "kind", "end").alias("anchor"), "low", "high", F.explode(F.sequence(F.floor(F.col("low") / BIN), F.floor(F.col("high") / BIN))).alias("bin"))
    partners = parts.where(~is_secret).select("row", F.struct("start", "kind", "end").alias("part"), F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("bin"))
    first = F.floor(F.greatest("low", "part.start") / BIN)
    met = scopes.join(partners, ["row", "bin"]).where((F.col("part.start") < F.col("high")) & (F.col("part.end") > F.col("low")) & (F.col("bin") == first))
    both = met.select("row", F.explode(F.array("anchor", "part")).alias("s")).where(F.col("s.kind") > 2).distinct()
    return both.groupBy("row").agg(F.collect_list("s").alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_sign: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    spans lists kind:start:end by start, then kind; found holds the same as structs
    (start, kind, end) with kind an index of KINDS. Null and empty texts have no spans;
    repeated rows stay; a null doc_id stays null; other columns are not read. with_sign
    adds sign, the text's xxhash64.
    """

    def rows(batches):
        for row, ids, sign, texts in batches:
            spans, parts = zip(*map(scan, texts))
            yield [row, ids, sign, [[dict(zip(("start", "kind", "end"), s)) for s in x] for x in spans], [[dict(zip(("start", "kind", "end", "low", "high"), p)) for p in x] for x in parts]]

    numbered = project(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("sign"), "text")
    ddl = f"row long, doc_id long, sign long, base {_SPANS}, parts array<struct<start: long, kind: int, end: long, low: long, high: long>>"
    found, _ = stage(map_rows(numbered, rows, ddl), "secrets")
    joined = found.select("row", "doc_id", "sign", "base").join(_linked(found), "row", "left")
    every = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked")))
    # a second parameter of the function would be the position, so the kind comes from a closure
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return joined.select("doc_id", *counts, F.sha2(_named("base"), 256).alias("base_sha256"), _named(every).alias("spans"), every.alias("found"), *["sign"] * with_sign)


def mask(text: str, found: list[tuple[int, int]]) -> str:
    """The text with each found stretch [start, end) replaced by MASK; overlapping ones are one."""
    out, at = [], 0
    for start, end in sorted(found):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = MASKED) -> DataFrame:
    """docs with every span of the kinds that find_secrets reports masked in the text; all rows and columns stay.

    Rows are matched to their spans by id and a digest of the text, so repeated ids with
    different texts keep their own spans, and a null id is one like any other.
    """
    asked = [KINDS.index(k) for k in kinds]
    found = find_secrets(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), with_sign=True)
    found = found.withColumn("found", F.filter("found", lambda s: s["kind"].isin(asked))).where(F.size("found") > 0)
    found = found.groupBy(F.col("doc_id").alias("id"), "sign").agg(F.first("found").alias("found"))
    found, _ = stage(found, "spans")
    # what is sent to every task is bounded by its spans, as a row may hold many
    few = (found.agg(F.sum(F.size("found"))).first()[0] or 0) <= SMALL_SIDE
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(own, F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("sign"))
    spans = (F.broadcast(found) if few else found).select(F.col("id").alias("span_id"), F.col("sign").alias("span_sign"), "found")
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("sign") == F.col("span_sign")), "left").select("row", "found")
    at = docs.columns.index(text_col)

    def run(batches):
        for b in sliced(batches, BATCH_ROWS):
            columns, hit = b.column(0).flatten(), b.column(1)
            if hit.null_count < len(hit):
                spans, texts = hit.to_pylist(), columns[at].to_pylist()
                columns[at] = pa.array([t if s is None else mask(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)], type=columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    return joined.mapInArrow(run, docs.schema)
