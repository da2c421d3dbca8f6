"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortaudit.llm.common import discard, stage


def _hook(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point the neighbours of each node (all, or the smaller ones and itself) to its smallest neighbour."""
    if larger_only:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(low, "u")
    if larger_only:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) undirected edges -> (node long, root long), root the smallest node reachable.

    Only nodes with an edge appear; self-loops and repeated edges don't matter, an
    empty table gives an empty one. Each round is a written table, so lineage stays
    short, and no round gathers a node's neighbours into one value: every step is a
    minimum by key and an equi-join that adaptive execution may split.
    """
    spark = edges.sparkSession
    at, path = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        new, new_path = stage(_hook(_hook(at, True), False), "edges")
        discard(spark, path)
        at, path = new, new_path
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return at.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(at.select(F.col("b"), F.col("b")).distinct())
