"""Exact top-k inner products by a three-phase uniform threshold.

The score of a query and a vector is the sum of partial scores over slices of the
dimensions. Phase 1 gathers each slice's highest partial scores for each query, and from
them a lower bound of the k-th best score. Phase 2 sends that cutoff out: a vector can
only reach it if one of its m partial scores, counted from the slice's lowest, is at
least an m-th of it. Phase 3 computes the scores of the vectors that remain exactly.
Queries go in blocks of bounded size, each a round of two scans with a written result;
vectors are never paired by a join.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortaudit.llm.common import arrow_schema, discard, run_starts, scratch_root, sliced, stage

SLICES = 4
#: Queries in a block, which one scan of the vectors serves, and those compared at once.
BLOCK, AT_ONCE = 32_768, 2048
#: Vectors compared at once.
ROWS = 1024


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id long, v array<long>), components floor(scale * x).

    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, are left out. An empty vector stays and scores 0 with other empty ones.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def _matrices(batches, dim: int):
    """(ids, rows of dim integers) of the vectors of that length."""
    for b in sliced(batches, ROWS):
        v = b.column(1)
        sizes = np.diff(v.offsets.to_numpy())
        own = sizes == dim
        flat = v.flatten().to_numpy(zero_copy_only=False)
        ids = b.column(0).to_numpy(zero_copy_only=False)
        if own.any():
            yield ids[own], (flat if own.all() else flat[np.repeat(own, sizes)]).reshape(int(own.sum()), dim).astype(np.int64)


def _product(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """c @ q.T in whole numbers: in floating point where that is exact."""
    bound = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    if bound < 2**53:
        return (c.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    if bound < 2**63:
        return c @ q.T
    raise OverflowError("an inner product may exceed 64 bits")


def _slices(dim: int, m: int) -> list[slice]:
    m = max(1, min(m, dim))
    return [slice(dim * j // m, dim * (j + 1) // m) for j in range(m)]


_LISTS = "q int, j int, row long, partial long, low long"


def _local_lists(ids: np.ndarray, queries: np.ndarray, parts: list[slice], k: int):
    """Phase 1 in a task: for each query and slice the k highest partial scores and the lowest."""
    schema = arrow_schema(_LISTS)

    def run(batches):
        m, n = len(parts), len(ids)
        best = np.full((m, n, k), np.iinfo(np.int64).min)
        who = np.full((m, n, k), -1)
        low = np.full((m, n), np.iinfo(np.int64).max)
        count = 0
        base = TaskContext.get().partitionId() << 40
        for own, c in _matrices(batches, queries.shape[1]):
            rows = base + count + np.arange(len(own))
            count += len(own)
            for j, part in enumerate(parts):
                for at in range(0, n, AT_ONCE):
                    few = slice(at, at + AT_ONCE)
                    other = own[None, :] != ids[few, None]
                    p = _product(queries[few, part], c[:, part])
                    low[j, few] = np.minimum(low[j, few], np.where(other, p, np.iinfo(np.int64).max).min(axis=1))
                    p[~other] = np.iinfo(np.int64).min
                    top = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
                    both = np.concatenate((best[j, few], np.take_along_axis(p, top, 1)), axis=1)
                    name = np.concatenate((who[j, few], np.where(np.take_along_axis(other, top, 1), rows[top], -1)), axis=1)
                    keep = np.argsort(-both, axis=1, kind="stable")[:, :k]
                    best[j, few], who[j, few] = np.take_along_axis(both, keep, 1), np.take_along_axis(name, keep, 1)
        j, q, at = np.nonzero(who >= 0)
        if len(j):
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(j, pa.int32()), pa.array(who[j, q, at]), pa.array(best[j, q, at]), pa.array(low[j, q])], schema=schema)

    return run


def _resolve(ids: np.ndarray, queries: np.ndarray, parts: list[slice], k: int, low: np.ndarray, cutoff: np.ndarray):
    """Phases 2 and 3 in a task: entries that can reach the cutoff, their exact scores, the k best of each query."""
    schema = arrow_schema("query_id long, vec_id long, score long")

    def run(batches):
        m = len(parts)
        found = [np.zeros(0, np.int64)] * 3
        for own, c in _matrices(batches, queries.shape[1]):
            for at in range(0, len(ids), AT_ONCE):
                few = slice(at, at + AT_ONCE)
                other = own[None, :] != ids[few, None]
                # p is counted from the slice's lowest, so m * p >= cutoff in some slice of each entry that reaches it
                upper = np.zeros(other.shape, np.int64)
                some = np.zeros(other.shape, bool)
                for j, part in enumerate(parts):
                    p = (_product(queries[few, part], c[:, part]) - low[j, few][:, None]) * m
                    high = p >= cutoff[few, None]
                    some |= high
                    upper += np.where(high, p, cutoff[few, None])
                q, r = np.nonzero(some & other & (upper >= m * cutoff[few, None]))
                q += at
                score = np.concatenate([np.einsum("ij,ij->i", queries[q[a : a + 65536]], c[r[a : a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
                keep = score - low.sum(axis=0)[q] >= cutoff[q]
                found = [np.concatenate(x) for x in zip(found, (q[keep], own[r[keep]], score[keep]))]
            by = np.lexsort((found[1], -found[2], found[0]))
            found = [x[by] for x in found]
            first = run_starts(found[0])
            place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
            found = [x[place < k] for x in found]
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(found[1]), pa.array(found[2])], schema=schema)

    return run


def _cutoffs(lists: DataFrame, n: int, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest partial scores (m, n), and each query's cutoff counted from their sum."""
    low = np.zeros((m, n), np.int64)
    for r in lists.groupBy("q", "j").agg(F.min("low").alias("low")).collect():
        low[r.j, r.q] = r.low
    floors = Window.partitionBy("q", "j")
    best = lists.withColumn("low", F.min("low").over(floors)).withColumn("n", F.row_number().over(floors.orderBy(F.desc("partial"), "row"))).where(F.col("n") <= k)
    sums = best.groupBy("q", "row").agg(F.sum(F.col("partial") - F.col("low")).alias("s"))
    ranked = sums.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "row"))).where(F.col("n") == k)
    cutoff = np.zeros(n, np.int64)
    for r in ranked.collect():
        cutoff[r.q] = r.s
    return low, cutoff


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, slices: int = SLICES, block: int = BLOCK) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k highest inner products.

    Both tables hold (vec_id long, v array<long>), see quantize(). Rows with the query's
    own id are no candidates, nor are vectors of another length. Ties go to the smaller
    vec_id. A query id that repeats is one query, with its smallest vector; candidate
    rows that repeat each count. With fewer candidates than k all are returned.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    queries, path = stage(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-queries.count() // block))
    found = f"{scratch_root(spark)}/found-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(f"{found}/block=-1")
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        for dim in sorted({len(r.v) for r in rows}):
            own = sorted(((r.vec_id, r.v) for r in rows if len(r.v) == dim))
            ids, q = np.array([x for x, _ in own], np.int64), np.array([v for _, v in own], np.int64).reshape(len(own), dim)
            parts = _slices(dim, slices)
            lists, lists_path = stage(vectors.mapInArrow(_local_lists(ids, q, parts, k), _LISTS), "lists")
            low, cutoff = _cutoffs(lists, len(ids), len(parts), k)
            vectors.mapInArrow(_resolve(ids, q, parts, k, low, cutoff), schema).write.mode("append").parquet(f"{found}/block={b}")
            discard(spark, lists_path)
    discard(spark, path)
    out = spark.read.schema(schema + ", block int").parquet(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
