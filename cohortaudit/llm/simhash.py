"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Fingerprints that share a block are laid in tiles by population count and compared by
exclusive-or and bit counts; tile pairs whose counts differ by more than the radius are
never formed. Blocks come from the fingerprint or from the text:

* bits (64 bits, small radius): two fingerprints within `radius` bits agree in all but
  `radius` of any blocks of bits, so keys of that many blocks find every pair that comparing
  all with all finds; the more fingerprints there are, the more blocks and the wider the keys;
* least shingle hashes (wide fingerprints, similarity of shingle sets): a block is three
  least hashes. Such links only say what is to be compared: the shingle sets of what they
  connect are, exactly.

A block of many rows first meets one of its rows, and what is within radius of that is
linked to it; only the others are compared with all, after a division by further least
hashes where they too are many. So the work stays in proportion to a block's rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortaudit.llm.common import LOWER_TABLE, discard, map_rows, project, small_side, stage
from cohortaudit.llm.components import connected_components

BITS = 64
SEED = 42
#: Fingerprints in a tile at most (in expectation, as salts are hashes).
TILE = 1024
#: How often a block of many rows is divided before its tiles are compared in pairs.
ROUNDS = 3
_BLANK = re.compile(rb"[\x20\x09-\x0D]+")
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, A-Z lower-cased, repeats included; of all words where they are fewer."""
    words = [w for w in _BLANK.split((text or "").encode().translate(LOWER_TABLE)) if w]
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)))), np.uint64)


def _remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash; the 0th is itself."""
    if not k:
        return hashes
    x = hashes + np.uint64(_MIX[0] * k % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 where there are no words."""
    return majority(shingles(text, width))


def least_hashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of `count` further 32-bit hashes of the hashes."""
    factors = (_remix(np.arange(1, count + 1, dtype=np.uint64), 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = np.full(count, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (x[at : at + 4096, None] * factors).min(axis=0))
    return low


def _block_keys(low: np.ndarray, rows: int) -> list[int]:
    """A signed long for each run of `rows` least hashes, told apart by the run's place."""
    return [_signed(xxhash.xxh64_intdigest(low[i : i + rows].tobytes(), i)) for i in range(0, len(low), rows)]


def sketch(text: str | None, width: int, words: int, blocks: int = 0, rows: int = 1, more: int = 0) -> list:
    """Fingerprint of 64 * words bits as signed longs; with blocks also block keys, further keys, digest and size of the set of hashes.

    With blocks repeats don't count.
    """
    hashes = shingles(text, width)
    if blocks:
        hashes = np.unique(hashes)
    prints = [_signed(majority(_remix(hashes, k))) for k in range(words)]
    if not blocks:
        return [prints]
    low = least_hashes(hashes, blocks * rows + more)
    return [prints, _block_keys(low[: blocks * rows], rows), low[blocks * rows :].tolist(), _signed(xxhash.xxh64_intdigest(hashes.tobytes())), len(hashes)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1, blocks: int = 0, rows: int = 1, more: int = 0) -> DataFrame:
    """(doc_id long, sign long, fp array<long>), a row for each row of docs; sign is the text's xxhash64.

    With blocks > 0 also keys and more, array<long>, and body long and size long, the
    digest and size of the set of shingles.
    """

    def made(batches):
        for ids, signs, texts in batches:
            yield [ids, signs, *(list(c) for c in zip(*(sketch(t, width, words, blocks, rows, more) for t in texts)))]

    signed = project(docs, id_col, text_col).select("doc_id", F.xxhash64("text"), "text")
    return map_rows(signed, made, "doc_id long, sign long, fp array<long>" + ", keys array<long>, more array<long>, body long, size long" * (blocks > 0))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; the last axis holds a fingerprint's words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _forest(fp: np.ndarray, near: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is within radius among fp, at most one for each row.

    near: 0 for the first tile of a pair and 1 for the second; only rows of different
    tiles are compared then. A frontier meets all rows that are not reached yet, as a
    matrix of exclusive-or and bit counts.
    """
    cross = near.any() and not near.all()
    left = np.arange(len(fp))
    child, parent = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = np.zeros(len(left), bool)
            by = np.zeros(len(left), np.int64)
            for at in range(0, len(front), 64):
                part = front[at : at + 64]
                close = _far(fp[part][:, None], fp[left][None, :]) <= radius
                if cross:
                    close &= near[part][:, None] != near[left][None, :]
                hit = close.any(axis=0) & ~found
                by[hit] = part[close[:, hit].argmax(axis=0)]
                found |= hit
            child.append(left[found])
            parent.append(by[found])
            front, left = left[found], left[~found]
    if not child:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(child), np.concatenate(parent)


def _small(fp: np.ndarray, unit: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within units of a few rows each, all units at once."""
    child, parent = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(unit[k:] == unit[:-k])
        i = i[_far(fp[i], fp[i + k]) <= radius]
        child.append(i + k)
        parent.append(i)
    return np.concatenate(child), np.concatenate(parent)


def _compare(radius: int, words: int):
    few = 6

    def solve(u1, u2, side, node, fp):
        unit = np.flatnonzero(np.concatenate(([True], (u1[1:] != u1[:-1]) | (u2[1:] != u2[:-1]))))
        size = np.diff(np.append(unit, len(node)))
        number = np.repeat(np.arange(len(unit)), size)
        pure = np.ones(len(unit), bool)
        pure[number[side > 0]] = False
        child, parent = [], []
        rows = np.flatnonzero((size <= few)[number] & pure[number])
        c, p = _small(fp[rows], number[rows], size[number[rows]], radius)
        child.append(node[rows][c]), parent.append(node[rows][p])
        for k in np.flatnonzero((size > few) | ~pure):
            part = slice(unit[k], unit[k] + size[k])
            c, p = _forest(fp[part], side[part], radius)
            child.append(node[part][c]), parent.append(node[part][p])
        return [np.concatenate(child), np.concatenate(parent)]

    def rows(batches):
        held = None
        for u1, u2, side, node, fp in batches:
            now = [*(np.array(c, np.int64) for c in (u1, u2, side, node)), np.array(fp, np.int64).view(np.uint64).reshape(-1, words)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(last) and len(held[0]) >= 20_000:  # what may go on in the next batch stays
                cut = last[-1] + 1
                yield solve(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None:
            yield solve(*held)

    return rows


#: Rows that chance alone may put into a bucket before fingerprints are cut into more blocks.
CROWD = 64


def block_count(n: int, radius: int) -> int:
    """The fewest blocks whose keys are so wide that n evenly spread fingerprints leave at most CROWD to a bucket."""
    blocks = radius + 1
    while n >> (BITS * (blocks - radius) // blocks) > CROWD:
        blocks += 1
    return blocks


def band_keys(fp: F.Column, radius: int, blocks: int | None = None) -> F.Column:
    """Block keys of a 64-bit fingerprint: one for each choice of `blocks` - radius of its blocks of bits.

    Fingerprints within radius differ in at most that many blocks, so they share a key. With
    radius + 1 blocks (the default) each block is a key; more give more and wider keys.
    """
    blocks = blocks or radius + 1
    at = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << at[i + 1]) - (1 << at[i]) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return F.array(*(F.xxhash64(fp.bitwiseAND(F.lit(m - (m >> 63 << 64))), F.lit(i)) for i, m in enumerate(masks)))


def _tiled(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """(bucket, late, node, fp) -> (bucket, pair, side, node, fp), the tile pairs of each bucket.

    A tile holds rows of radius + 1 neighbouring population counts; tiles whose counts
    differ beyond the radius make no pair, nor do two tiles of rows that are not late.
    """
    pop = F.aggregate("fp", F.lit(0), lambda a, x: a + F.bit_count(x))
    rows = rows.select("bucket", F.struct("late", F.floor(pop / (radius + 1)).alias("pops")).alias("tile"), "node", "fp")
    tiles = rows.groupBy("bucket", "tile").agg(F.ceil(F.count("*") / F.lit(float(tile))).cast("int").alias("salts"))
    other = tiles.select("bucket", F.col("tile").alias("tile2"), F.col("salts").alias("salts2"))
    near = (F.col("tile2") >= F.col("tile")) & (F.abs(F.col("tile2.pops") - F.col("tile.pops")) <= 1) & (F.col("tile.late") | F.col("tile2.late"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = tiles.join(other, "bucket").where(near).select("bucket", "tile", every("salts").alias("salt"), "tile2", "salts2").select("bucket", "tile", "salt", "tile2", every("salts2").alias("salt2"))
    differ = F.col("tile") < F.col("tile2")
    pairs = pairs.where(differ | (F.col("salt") <= F.col("salt2"))).withColumn("pair", F.xxhash64("tile", "salt", "tile2", "salt2"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    second = pairs.where(differ | (F.col("salt") < F.col("salt2"))).select("bucket", "pair", one.alias("side"), F.col("tile2").alias("tile"), F.col("salt2").alias("salt"))
    parts = pairs.select("bucket", "pair", zero.alias("side"), "tile", "salt").union(second)
    salted = rows.join(tiles, ["bucket", "tile"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    return salted.join(parts, ["bucket", "tile", "salt"]).select("bucket", "pair", "side", "node", "fp")


def links(prints: DataFrame, radius: int = 2, words: int = 1, tile: int = TILE) -> tuple[DataFrame, list[str]]:
    """(node long, fp array<long>, keys array<long>[, more array<long>]) -> (a long, b long), edges between nodes within radius, and scratch tables that they are read from.

    Not every pair that shares a key is returned, but whatever such pairs connect, the
    edges connect, and no unit gives more edges than it has rows. With `more`, a bucket
    with over `tile` rows beyond the radius of its first one is divided, ROUNDS - 1
    times, by the further keys: a pair that shares none of them is lost.
    """
    divide = ["more"] * ("more" in prints.columns)
    rows, paths, edges = prints.select("node", F.explode("keys").alias("bucket")), [], []
    first_unit = [F.lit(0).cast("long").alias(c) for c in ("pair", "side")]
    for left in reversed(range(ROUNDS if divide else 1)):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        shared, path = stage(rows.join(sizes, "bucket").join(prints.select("node", "fp", *divide), "node"), "shared")
        paths.append(path)
        units = shared.where(F.col("n") <= tile).select("bucket", *first_unit, "node", "fp")
        large = shared.where(F.col("n") > tile)
        done = large.isEmpty()
        if not done:
            # a row for each bucket of over `tile` rows, which meets them where they lie
            first = small_side(large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("hash"), "node", "fp")).alias("first")), "first")
            apart = F.aggregate(F.zip_with("fp", "first.fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
            met, path = stage(large.join(first, "bucket").select("bucket", "node", "fp", *divide, F.col("first.node").alias("first"), (apart > radius).alias("late")), "met")
            paths.append(path)
            edges.append(met.where(~F.col("late") & (F.col("node") != F.col("first"))).select(F.col("node").alias("a"), F.col("first").alias("b")))
            late = met.where("late").groupBy("bucket").agg(F.count("*").alias("n"))
            now = late if not left else late.where(F.col("n") <= tile)
            units = units.union(_tiled(met.join(now.select("bucket"), "bucket"), radius, tile))
            if left:
                again = met.join(late.where(F.col("n") > tile).select("bucket"), "bucket").select("bucket", "node", F.posexplode("more"))
                rows = again.select("node", F.xxhash64("bucket", "pos", "col").alias("bucket"))
        units = units.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "side", "node")
        edges.append(map_rows(units, _compare(radius, words), "a long, b long"))
        if done:
            break
    for e in edges[1:]:
        edges[0] = edges[0].union(e)
    return edges[0], paths


def _linked(prints: DataFrame, radius: int, words: int = 1, tile: int = TILE) -> DataFrame:
    """(node, root) of what links() connects."""
    edges, paths = links(prints, radius, words, tile)
    found = connected_components(edges)
    for path in paths:
        discard(prints.sparkSession, path)
    return found


def _named(prints: DataFrame, groups: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """prints (doc_id, sign, fp) with the smallest doc_id of the groups, known by the columns `by`, that a root joins."""
    joined = groups.select(*by, "least", F.col("node").alias("own")).join(roots, F.col("own") == F.col("node"), "left").select(*by, "least", F.coalesce("root", "own").alias("root"))
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of, _ = stage(joined.join(names, "root").select(*by, "component_id"), "members")
    return prints.join(of, by).select("doc_id", "sign", "fp", "component_id")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id long, sign long, fp array<long>, component_id long), a row for each row of docs.

    Keys are blocks of one word's bits (block_count), and every pair within radius shares one. component_id is
    the smallest doc_id reachable over links of at most radius bits. Null, empty and
    blank texts have fingerprint zero and link like any other. Repeated rows stay
    repeated. A null doc_id can't be a component's name: component_id is null only if no
    row of the component has a doc_id. Other columns are not read.
    """
    prints, _ = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups, _ = stage(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    keys = band_keys(F.col("fp")[0], radius, block_count(groups.count(), radius))
    return _named(prints, groups, _linked(groups.select("node", "fp", keys.alias("keys")), radius), ["fp"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long): components() of 64-bit fingerprints linked within radius."""
    found = components(docs, id_col, text_col, width, radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


#: Copies have sets of five-word shingles with a similarity of SHARE or more. Bits, radius
#: and blocks only choose what is compared: at 0.8, 256 * acos(2 s / (1 + s)) / pi is 39
#: bits with a deviation of 6, so the radius is over five deviations beyond; one of 16
#: blocks of three least hashes is shared but for (1 - 0.8 ** 3) ** 16, 1 in 100,000 of
#: such pairs, one of 10 further keys but for 1 in 10 million.
COPIES = {"width": 5, "words": 4, "radius": 72, "blocks": 16, "rows": 3, "more": 10}
SHARE = (4, 5)
#: Shingles in a tile of sets at most (in expectation), each set counting SET more.
SHINGLES, SET = 1 << 20, 512


def _alike(sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, first of its component) for the components that pairs of SHARE or more make among sets of distinct hashes.

    side: as near in _forest.
    """
    over, of = SHARE
    cross = side.any() and not side.all()
    size = np.array([len(s) for s in sets], np.int64)
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mark = np.zeros(int(size.sum()), bool)
    left = np.arange(len(sets))
    child, parent = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        first, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            at = left[of * np.minimum(size[left], size[x]) >= over * np.maximum(size[left], size[x])]
            if cross:
                at = at[side[at] != side[x]]
            mark[ids[x]] = True
            both = np.array([np.count_nonzero(mark[ids[i]]) for i in at], np.int64)
            mark[ids[x]] = False
            hit = at[(over + of) * both >= over * (size[x] + size[at])]
            child.append(hit)
            parent.append(np.full(len(hit), first))
            front += hit.tolist()
            left = left[~np.isin(left, hit, assume_unique=True)]
    return np.concatenate(child), np.concatenate(parent)


def _confirm(units: DataFrame) -> DataFrame:
    """(root, low, high, side, node, body) -> (a long, b long): each unit's members and the first of their component."""

    def solve(rows):
        nodes = np.array([r[0] for r in rows], np.int64)
        child, parent = _alike([np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[1] for r in rows], bool))
        return nodes[child].tolist(), nodes[parent].tolist()

    def compare(batches):
        unit, held = None, []
        for root, low, high, side, node, body in batches:
            a, b = [], []
            for *now, s, n, hashes in zip(root, low, high, side, node, body):
                if now != unit:
                    for out, more in zip((a, b), solve(held) if len(held) > 1 else ()):
                        out += more
                    unit, held = now, []
                if not held or held[-1][:2] != (n, s):  # rows repeat
                    held.append((n, s, hashes))
            yield [a, b]
        if len(held) > 1:
            yield list(solve(held))

    units = units.select("root", "low", "high", "side", "node", "body")
    return map_rows(units.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "side", "node"), compare, "a long, b long")


def _between(sets: DataFrame, inside: DataFrame, tile: int) -> DataFrame:
    """(a, b), edges between the tiles of roots that fill several; inside: the edges within tiles.

    The first of each tile's largest component meets the others' in one unit. What lies
    in the largest component then is not compared with its like again, only the members
    outside it with all.
    """
    named = inside.select(F.col("a").alias("node"), F.col("b").alias("label"))
    sets = sets.join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_tile = sets.groupBy("root", "salt", "label").agg(F.countDistinct("node").alias("n"))
    heads = by_tile.groupBy("root", "salt").agg(F.max(F.struct("n", "label")).alias("h")).select("root", F.col("h.n").alias("n"), F.col("h.label").alias("label"))
    heads, _ = stage(heads, "heads")
    zero = F.lit(0).cast("long")
    of_heads = sets.join(heads.select("label").distinct(), "label", "left_semi").where("node = label")
    merged, _ = stage(_confirm(of_heads.withColumn("low", zero).withColumn("high", zero).withColumn("side", F.lit(False))), "merged")
    joined = heads.join(merged, F.col("label") == F.col("a"), "left").select("root", "label", "n", F.coalesce("b", "label").alias("head"))
    main = joined.groupBy("root", "head").agg(F.sum("n").alias("n")).groupBy("root").agg(F.max(F.struct("n", "head")).alias("h")).select("root", F.col("h.head").alias("head"))
    main = joined.join(main, ["root", "head"]).select("label", F.lit(True).alias("main"))
    sets = sets.join(main, "label", "left")
    late = sets.where("main is null")
    many = late.groupBy("root").agg(F.ceil(F.sum(F.length("body") / 8 + SET) / F.lit(float(tile))).cast("long").alias("lates"))
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    early = sets.where("main").join(many, "root").select("root", F.col("salt").alias("low"), every("lates").alias("high"), F.lit(False).alias("side"), "node", "body")
    late = late.join(many, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("lates")))
    met = late.select("root", every("salts").alias("low"), F.col("own").alias("high"), F.lit(True).alias("side"), "node", "body")
    # units of late members among themselves have low beyond the tiles
    among = late.select("root", "salts", "own", every("lates").alias("other"), "node", "body")
    among = among.select("root", (F.col("salts") + F.least("own", "other")).alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("side"), "node", "body")
    return merged.union(_confirm(early.union(met).union(among)))


def confirmed(docs: DataFrame, members: DataFrame, width: int, tile: int) -> DataFrame:
    """(a long, b long), edges that connect the members of a root whose sets of shingles have a similarity of SHARE or more.

    docs: (doc_id, text); members: (root, node, size, row (doc_id, sign) of a text with
    the node's set). A root's members are compared in tiles, and then between tiles what
    is not in the root's largest component.
    """

    def sets(batches):
        for root, salts, salt, node, texts in batches:
            yield [root, salts, salt, node, [np.unique(shingles(t, width)).tobytes() for t in texts]]

    tiles = members.groupBy("root").agg(F.ceil(F.sum(F.col("size") + SET) / F.lit(float(tile))).cast("long").alias("salts"))
    rows = members.join(tiles, "root").select("root", "salts", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), "node", F.col("row.doc_id").alias("_id"), F.col("row.sign").alias("_sign"))
    rows = small_side(rows, "rows")
    texts = docs.join(rows, docs["doc_id"].eqNullSafe(rows["_id"]) & (F.xxhash64(docs["text"]) == rows["_sign"])).select("root", "salts", "salt", "node", "text")
    found, _ = stage(map_rows(texts, sets, "root long, salts long, salt long, node long, body binary"), "sets")
    inside, _ = stage(_confirm(found.select("root", F.col("salt").alias("low"), F.col("salt").alias("high"), F.lit(False).alias("side"), "node", "body")), "inside")
    large = found.where("salts > 1")
    return inside if large.isEmpty() else inside.union(_between(large, inside, tile))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = SHINGLES) -> DataFrame:
    """(doc_id long, sign long, fp array<long>, component_id long): as components(), but links are similarities of SHARE or more.

    Texts with the same set of shingles are one node; texts without words are alike.
    """
    width, words, radius, blocks, rows, more = (COPIES[k] for k in ("width", "words", "radius", "blocks", "rows", "more"))
    prints, _ = stage(fingerprints(docs, id_col, text_col, width, words, blocks, rows, more), "fingerprints")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sign")).alias("row")
    groups = prints.groupBy("body", "size", "fp").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.first("more").alias("more"), row)
    groups, _ = stage(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    near = _linked(groups.select("node", "fp", "keys", "more"), radius, words)
    edges = confirmed(project(docs, id_col, text_col), groups.join(near, "node").select("root", "node", "size", "row"), width, tile)
    return _named(prints, groups, connected_components(edges), ["body", "size", "fp"])
