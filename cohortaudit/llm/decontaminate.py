"""Benchmark decontamination over suffix arrays of the training texts.

Each shard (a few MB of documents in a Spark task) gets a suffix array over its words.
A match can only hold words that the benchmark has, so the array is sparse: it keeps the
suffixes whose first words, as many as the shortest window, are all benchmark words, and
a suffix ends at the first other word or at its document's end. Every test suffix is
looked up by binary search, all at once; its neighbours there tell its longest match, and
where that holds a window, the stretch of the array that begins with the window has all
places. The benchmark is bounded before it is sent to
the tasks, and goes in blocks where it is larger.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortaudit.llm.common import WORD_TABLE, buffered, keep_rows, map_rows, project, run_starts, stage, text_size, words_of

WINDOW = 10
#: Characters of training text in a shard, and of benchmark text in a block.
SHARD_CHARS, BLOCK_CHARS = 2_000_000, 4_000_000
_MARK = b"\xff"


class Ranks:
    """Ranks of the stretches of 1, 2, 4, ... words at every place of a shard and of the tests, by doubling.

    Equal ranks are equal stretches, whole or up to the same end, so two suffixes are
    compared in as many steps as there are doublings, however long they agree.
    """

    def __init__(self, ids: np.ndarray, left: np.ndarray):
        self.left, self.levels = left, []
        live = np.flatnonzero(left > 0)
        rank = np.zeros(len(ids), np.int64)
        rank[live] = np.unique(ids[live], return_inverse=True)[1] + 1
        width = 1
        while True:
            self.levels.append(rank.astype(np.int32))
            if width >= left.max(initial=0) or rank.max(initial=0) == len(live):
                break
            rest = np.where(left[live] > width, rank[np.minimum(live + width, len(ids) - 1)], 0)
            key = rank[live] * (len(ids) + 1) + rest
            rank = np.zeros(len(ids), np.int64)
            rank[live] = np.unique(key, return_inverse=True)[1] + 1
            width *= 2

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The words that the suffixes at a and b have in common, up to limit."""
        done = np.zeros(len(a), np.int64)
        most = np.minimum(limit, np.minimum(self.left[a], self.left[b]))
        for k in range(len(self.levels) - 1, -1, -1):
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                fits = done + (1 << k) <= most
                x, y = np.where(fits, a + done, 0), np.where(fits, b + done, 0)
                done += np.where(fits & (self.levels[k][x] == self.levels[k][y]), 1 << k, 0)
        return done


class Tests:
    """The benchmark's words as numbers and its suffixes.

    owner is a suffix's item, left its length, need the length of the window that begins
    there (0 for none): `window` words, or all of a shorter item.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        words = [(i, words_of(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))]
        words = [(i, w) for i, w in words if w]
        self.items = [i for i, _ in words]
        self.number = {w: n for n, w in enumerate(sorted({x for _, w in words for x in w}), 1)}
        sizes = np.array([len(w) for _, w in words], np.int64)
        self.ids = np.fromiter((self.number[x] for _, w in words for x in w), np.int32)
        self.number[_MARK] = -1
        self.owner = np.repeat(np.arange(len(words)), sizes)
        self.position = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = np.repeat(sizes, sizes) - self.position
        need = np.minimum(window, np.repeat(sizes, sizes))
        self.need = np.where(self.left >= need, need, 0)
        self.shortest, self.window = int(sizes.min(initial=window)), window
        self.sorted = np.argsort(Ranks(self.ids, self.left).levels[-1], kind="stable")

    def suffixes(self) -> np.ndarray:
        return np.arange(len(self.ids))


#: Words that suffixes may share before they are compared by ranks.
NEAR = 48


class Shard:
    """The sparse suffix array of some documents."""

    def __init__(self, texts: list[str | None], tests: Tests):
        joined = b" \xff ".join((t or "").encode() for t in texts).translate(WORD_TABLE)
        number = tests.number
        self.ids = np.fromiter((number.get(w, 0) for w in joined.split()), np.int32)
        marks = np.flatnonzero(self.ids == -1)
        self.first = np.concatenate(([0], marks + 1)).astype(np.int64)
        self.end = np.concatenate((marks, [len(self.ids)])).astype(np.int64)
        n = len(self.ids)
        stop = np.where(self.ids > 0, n, np.arange(n))
        self.left = (np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)) if n else stop
        self.tests, self.made = tests, None
        self.order = self._sorted(np.flatnonzero(self.left >= tests.shortest), int(tests.ids.max(initial=1)))

    @property
    def ranks(self) -> Ranks:
        """Made where a stretch of over NEAR words repeats or matches."""
        if self.made is None:
            self.made = Ranks(np.concatenate((self.ids, self.tests.ids)), np.concatenate((self.left, self.tests.left)))
        return self.made

    def _keys(self, at: np.ndarray, depth: np.ndarray | int, bits: int, words: int) -> np.ndarray:
        """The words at depth, packed; 0 beyond a suffix's end."""
        key = np.zeros(len(at), np.uint64)
        for k in range(words):
            live = self.left[at] > depth + k
            word = np.where(live, self.ids[np.where(live, at + depth + k, 0)], 0)
            key = (key << np.uint64(bits)) | word.astype(np.uint64)
        return key

    def _sorted(self, at: np.ndarray, largest: int) -> np.ndarray:
        bits = max(1, largest.bit_length())
        words = max(1, 64 // bits)
        group, depth = np.zeros(len(at), np.int64), 0
        tied = np.arange(len(at))
        while len(tied) > 1:
            key = self._keys(at[tied], depth, bits, words)
            by = np.lexsort((key, group[tied]))
            at[tied], key, own = at[tied][by], key[by], group[tied]
            new = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
            group[tied] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
            same = np.zeros(len(tied), bool)
            same[1:] = ~new[1:]
            same[:-1] |= ~new[1:]
            depth += words
            tied = tied[same & (self.left[at[tied]] >= depth)]
            if depth >= NEAR and len(tied):
                return at[np.argsort(self.ranks.levels[-1][at], kind="stable")]
        return at

    def compare(self, tests: Tests, suffix: np.ndarray, rank: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in common of the test suffixes and the suffixes at rank, up to limit, and whether the latter are smaller."""
        at, common = self.order[rank], np.zeros(len(suffix), np.int64)
        live, depth = np.arange(len(suffix)), 0
        while len(live) and self.made is None:
            live = live[(limit[live] > depth) & (self.left[at[live]] > depth)]
            live = live[self.ids[at[live] + depth] == tests.ids[suffix[live] + depth]]
            depth += 1
            common[live] = depth
            if depth == NEAR and len(live):
                self.ranks  # noqa: B018
        if len(live):
            common[live] = self.ranks.common(at[live], len(self.ids) + suffix[live], limit[live])
        open_ = common < limit
        has = open_ & (self.left[at] > common)
        ours = np.where(has, self.ids[np.where(has, at + common, 0)], 0)
        smaller = open_ & (ours < tests.ids[np.where(open_, suffix + common, 0)]) if len(suffix) else open_
        return common, smaller

    def search(self, tests: Tests, suffix: np.ndarray, limit: np.ndarray, after: bool = False) -> np.ndarray:
        """The rank of the first suffix that is not smaller (after: that is larger) in its first `limit` words."""
        low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(self.order), np.int64)
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) // 2
            common, smaller = self.compare(tests, suffix[k], mid, limit[k])
            right = smaller & (common < limit[k]) | (common >= limit[k]) & after
            low[k[right]] = mid[right] + 1
            high[k[~right]] = mid[~right]
        return low


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each interval's ranks, and the number of the interval."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner], owner


def _longest(shard: Shard, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """The length of each test suffix's longest match in the shard, that with a neighbour of its place in the array, and that place."""
    every = tests.suffixes()
    if not len(shard.order) or not len(every):
        return np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    rank = shard.search(tests, every, tests.left)
    sides = (shard.compare(tests, every, np.clip(rank + k, 0, len(shard.order) - 1), tests.left)[0] for k in (-1, 0))
    return np.maximum(*sides), rank


def _least_between(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value in each interval [low, high), none empty: the lesser of two stretches of a power of two that cover it."""
    out, size = np.zeros(len(low), value.dtype), high - low
    width, table = 1, value
    while len(table):
        now = np.flatnonzero((size >= width) & (size < 2 * width))
        out[now] = np.minimum(table[low[now]], table[high[now] - width])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table[:0]
        width *= 2
    return out


def _hits(texts: list, tests: Tests) -> tuple[list[int], list[list[dict]], list[list[int]], list[dict | None]]:
    """For each document: its words, its hit stretches of words, the items with windows in it, and its longest match."""
    shard = Shard(texts, tests)
    found, begins_at = _longest(shard, tests)
    suffix = np.flatnonzero((tests.need > 0) & (found >= tests.need))
    low = shard.search(tests, suffix, tests.need[suffix])
    high = shard.search(tests, suffix, tests.need[suffix], after=True)
    # windows of the same words are one stretch of the array; each is laid out once
    keys = np.stack((low, high, tests.need[suffix]), axis=1)
    stretches, which = np.unique(keys, axis=0, return_inverse=True) if len(keys) else (keys, low)
    which = which.reshape(-1)
    rank, of = _spread(stretches[:, 0], stretches[:, 1])
    at = shard.order[rank]
    doc = np.searchsorted(shard.first, at, "right") - 1
    cover = np.zeros(len(shard.ids) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + stretches[of, 2], -1)
    edge = np.diff(np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False])).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans: list[list[dict]] = [[] for _ in texts]
    for d, b, e in zip(np.searchsorted(shard.first, begins, "right") - 1, begins, ends):
        spans[d].append({"first": int(b - shard.first[d]), "last": int(e - shard.first[d])})
    # an item counts once for a stretch, and a stretch once for a document
    owners = np.unique(np.stack((which, tests.owner[suffix]), axis=1), axis=0) if len(suffix) else np.zeros((0, 2), np.int64)
    begin = np.searchsorted(owners[:, 0], np.arange(len(stretches) + 1))
    items: list[set] = [set() for _ in texts]
    seen = np.unique(doc * max(1, len(stretches)) + of)
    for x in seen.tolist():
        d, k = divmod(x, len(stretches))
        items[d].update(tests.items[i] for i in owners[begin[k] : begin[k + 1], 1].tolist())
    return (shard.end - shard.first).tolist(), spans, [sorted(s - {None}) for s in items], _longest_places(shard, tests, begins_at, stretches, len(texts))


def _longest_places(shard: Shard, tests: Tests, begins: np.ndarray, stretches: np.ndarray, n: int) -> list[dict | None]:
    """Each document's longest match that holds a window: of equally long ones the first in the document, then in the items.

    begins is where each test suffix belongs in the array. The longest match of a place
    with any test is that with a neighbour among the sorted tests; where it is shorter
    than a window, only whole short items that stand there count.
    """
    longest: list[dict | None] = [None] * n
    edges = np.zeros(len(shard.order) + 1, np.int64)
    whole = np.zeros(len(shard.order), np.int64)
    for low, high, need in stretches[np.argsort(stretches[:, 2], kind="stable")].tolist():
        edges[low] += 1
        edges[high] -= 1
        if need < tests.window:
            whole[low:high] = need
    held = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
    place = np.searchsorted(begins[tests.sorted], held, "right")
    length = np.zeros(len(held), np.int64)
    for k in (-1, 0):
        near = tests.sorted[np.clip(place + k, 0, len(tests.sorted) - 1)]
        length = np.maximum(length, shard.compare(tests, near, held, tests.left[near])[0])
    length = np.where(length >= tests.window, length, whole[held])
    at = shard.order[held]
    doc = np.searchsorted(shard.first, at, "right") - 1
    first = np.lexsort((at, -length, doc))
    for k in first[run_starts(doc[first])].tolist():
        d, start, size = int(doc[k]), int(at[k]), int(length[k])
        s = _first_suffix(shard, tests, start, size)
        longest[d] = {"length": size, "start": start - int(shard.first[d]), "item": tests.items[tests.owner[s]], "position": int(tests.position[s])}
    return longest


def _first_suffix(shard: Shard, tests: Tests, at: int, size: int) -> int:
    """The first test suffix with a window whose first `size` words stand at a place of the shard, as is known of one."""
    fits = (tests.ids == shard.ids[at]) & (tests.left >= size) & (tests.need > 0) & (tests.need <= size)
    suffix = np.flatnonzero(fits)
    if shard.made is not None:
        same = shard.ranks.common(np.full(len(suffix), at), len(shard.ids) + suffix, np.full(len(suffix), size))
        return int(suffix[np.flatnonzero(same >= size)[0]])
    for k in range(1, size):
        if len(suffix) == 1:
            break
        suffix = suffix[tests.ids[suffix + k] == shard.ids[at + k]]
    return int(suffix[0])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_chars: int):
    """The benchmark in blocks of about block_chars at most, each proven to be so by its size."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Tests([(r.item_id, r.text) for r in part.collect()], window)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, spans array<struct<first, last>>, items array<long>, longest struct<length, start, item, position>), a row for each row of docs.

    A window is `window` consecutive words of an item, or a shorter item whole; spans
    are the stretches [first, last) of a document's words inside windows' occurrences.
    longest is the longest match that holds a window: words, its start in the document, the
    item, and its start there; of equally long ones the first in the document, then in
    the items. Null and empty texts have no words; items without words and null item ids count for
    nothing in items, and rows that share an item id are one item; repeated rows stay; other columns are not read.
    """
    docs, spark = project(docs, id_col, text_col), docs.sparkSession
    ddl = "doc_id long, n_words long, spans array<struct<first: long, last: long>>, items array<long>, longest struct<length: long, start: long, item: long, position: long>"
    found = []
    for tests in _blocks(benchmark, item_col, item_text, window, block_chars):
        shared = spark.sparkContext.broadcast(tests)

        def rows(batches, shared=shared):
            for ids, texts in buffered(batches, SHARD_CHARS, text_size):
                yield [ids, *_hits(texts, shared.value)]

        found.append(rows)
    if len(found) == 1:
        return map_rows(docs, found[0], ddl)
    # the blocks' rows of a document meet by its row number, which the written table fixes
    docs, _ = stage(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts = []
    for rows in found:

        def with_row(batches, rows=rows):
            for row, ids, texts in buffered(batches, SHARD_CHARS, text_size):
                yield [row, *next(iter(rows(iter([[ids, texts]]))))]

        parts.append(map_rows(docs.select("row", "doc_id", "text"), with_row, "row long, " + ddl))
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    merged = both.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min_by("longest", F.when(F.col("longest").isNotNull(), F.struct(-F.col("longest.length"), "longest.start", "longest.item", "longest.position"))).alias("longest"))
    return merged.select("doc_id", "n_words", _merge_spans("spans").alias("spans"), "items", "longest")


def _merge_spans(column: str):
    """Unite sorted stretches that overlap or touch."""
    one = "array(named_struct('first', s.first, 'last', greatest(s.last, element_at(a, -1).last)))"
    return F.expr(
        f"aggregate({column}, cast(array() as array<struct<first: bigint, last: bigint>>), (a, s) -> "
        f"case when size(a) > 0 and element_at(a, -1).last >= s.first then concat(slice(a, 1, size(a) - 1), transform({one}, x -> named_struct('first', element_at(a, -1).first, 'last', x.last))) "
        "else concat(a, array(s)) end)"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_start, longest_item, longest_position), a row for each row of docs; see hits()."""
    found = hits(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    place = [F.col(f"longest.{c}").alias(f"longest_{c}") for c in ("start", "item", "position")]
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("longest.length", F.lit(0).cast("long")).alias("longest"), *place)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs' rows, with all their columns, that hits() finds no window in.

    Rows are searched where they lie, so nothing is joined and ids don't matter. A
    benchmark of several blocks takes a written table between two of them. Null and empty
    texts stay, as do all rows where no item has words.
    """
    for k, tests in enumerate(_blocks(benchmark, item_col, item_text, window, block_chars)):
        shared = docs.sparkSession.sparkContext.broadcast(tests)
        docs = stage(docs, "cleaned")[0] if k else docs
        docs = keep_rows(docs, text_col, lambda texts, shared=shared: [not s for s in _hits(texts, shared.value)[1]], SHARD_CHARS)
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, position, length, doc_id, start, places): each test suffix's longest verbatim match in all shards.

    position and start count words. places is how many places hold the match, (doc_id,
    start) the first of them in that order; suffixes whose match has fewer than `least`
    words are left out, and rows that share an item id are one item.
    """
    docs, spark = project(docs, id_col, text_col), docs.sparkSession
    out = None
    for tests in _blocks(benchmark, item_col, item_text, least, block_chars):
        tests.shortest = min(tests.shortest, least)
        shared = spark.sparkContext.broadcast(tests)

        def rows(batches, shared=shared):
            t = shared.value
            for ids, texts in buffered(batches, SHARD_CHARS, text_size):
                shard = Shard(texts, t)
                length = _longest(shard, t)[0]
                k = np.flatnonzero(length >= least)
                low, high = shard.search(t, k, length[k]), shard.search(t, k, length[k], after=True)
                doc = np.searchsorted(shard.first, shard.order, "right") - 1
                start = shard.order - shard.first[doc]
                known = np.array([d is not None for d in ids], bool)[doc]
                name = np.array([d or 0 for d in ids], np.int64)[doc]
                by = np.lexsort((start, name, ~known))
                place = np.empty(len(by), np.int64)
                place[by] = np.arange(len(by))
                first = by[_least_between(place, low, high)]
                yield [[t.items[o] for o in t.owner[k]], t.position[k].tolist(), length[k].tolist(), [ids[d] for d in doc[first]], start[first].tolist(), (high - low).tolist()]

        part = map_rows(docs, rows, "item_id long, position long, length long, doc_id long, start long, places long")
        out = part if out is None else out.union(part)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start")
    best = out.groupBy("item_id", "position", "length").agg(F.min(place).alias("m"), F.sum("places").alias("places"))
    best = best.groupBy("item_id", "position").agg(F.max_by(F.struct("length", "m.doc_id", "m.start", "places"), "length").alias("b"))
    return best.select("item_id", "position", "b.length", "b.doc_id", "b.start", "b.places")


def items_digest(items: list[int]) -> str:
    """items_sha256 of a list of item ids."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


ORACLE = """
with w as (
  select doc_id, pos - 1 as p, word from (
    select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from (
      select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents))),
b as (
  select item_id, ws, len(ws) as n from (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark)
  where len(ws) > 0),
win as (
  select item_id, i - 1 as q, least(n, 10) as l, array_to_string(ws[i:i + least(n, 10) - 1], ' ') as s
  from (select item_id, ws, n, unnest(range(1, greatest(n - 10, 0) + 2)) as i from b)),
lens as (select distinct l from win),
grams as (
  select doc_id, p, l, s from (
    select w.doc_id, w.p, lens.l, array_to_string(list(w.word) over (partition by w.doc_id, lens.l order by w.p rows between current row and 9 following), ' ') as s10,
      count(*) over (partition by w.doc_id, lens.l order by w.p rows between current row and 9 following) as c,
      array_to_string((list(w.word) over (partition by w.doc_id, lens.l order by w.p rows between current row and 9 following))[1:lens.l], ' ') as s
    from w cross join lens) where c >= l),
m as (select g.doc_id, g.p, g.l, win.item_id, win.q from grams g join win on g.l = win.l and g.s = win.s),
chains as (
  select doc_id, item_id, min(p) as start, min(q) as position, count(*) + any_value(l) - 1 as length
  from (select *, p - row_number() over (partition by doc_id, item_id, p - q order by p) as chain from m) group by doc_id, item_id, p - q, chain),
best as (select doc_id, arg_min({'n': length, 's': start, 'i': item_id, 'p': position}, [-length, start, item_id, position]) as b from chains group by doc_id),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + l)) as q from m) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names from (select distinct doc_id, item_id from m) group by doc_id),
n as (select doc_id, count(*) as n_words from w group by doc_id)
select d.doc_id, coalesce(n.n_words, 0)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items,
  sha256(coalesce(i.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated,
  coalesce(b.n, 0)::bigint as longest, b.s::bigint as longest_start, b.i::bigint as longest_item, b.p::bigint as longest_position
from documents d left join n using (doc_id) left join h using (doc_id) left join i using (doc_id) left join best using (doc_id)
"""
