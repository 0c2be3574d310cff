"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidary.llm.common import durable


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Contraction: in each round every node joins its neighbour (or itself) with the smallest
    hash under that round's seed, and edges move to the nodes joined.  Hashes change by round, so a long
    chain shrinks by a constant share as well.  A node's choice is a ``min`` with partial
    aggregation, and both sides of each join are checkpointed tables whose large partitions
    adaptive execution can split: a node with very many edges is no single task.
    Self loops and nulls are ignored.
    """
    pairs = edges.select("a", "b").where(F.col("a") != F.col("b"))
    live = durable(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = None
    for k in range(rounds):
        if live.isEmpty():
            break

        def rank(c: str, k: int = k):
            return F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("v"))

        best = live.groupBy("a").agg(F.min(rank("b")).alias("best"))
        joins = durable(best.select(F.col("a").alias("node"), F.least(rank("a"), F.col("best"))["v"].alias("to")))
        left = joins.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = joins.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = live.join(left, "a").select("to_a", "b").join(right, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        live = durable(moved.where(F.col("a") != F.col("b")).distinct())
        if roots is None:
            roots = joins.select("node", F.col("to").alias("root"))
        else:
            step = joins.select(F.col("node").alias("root"), "to")
            roots = durable(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if roots is None:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    least = durable(roots.groupBy("root").agg(F.min("node").alias("least")))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))
