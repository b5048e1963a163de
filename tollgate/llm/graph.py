"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-step.  Large: each node's greater neighbours move to its least
    neighbour (or itself); small: its lesser neighbours and itself do."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a").select("b", "m", "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "edges", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of
    its component.  Alternates large-star and small-star steps, each a grouping
    and a join on the node, until no edge changes: O(log² n) rounds, after which
    all edges are (node, root).  A round starts from a written table."""
    now = written(edges.where("a <> b").distinct(), label)
    state = None
    for _ in range(rounds):
        print_of = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(print_of) == state or not print_of[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = tuple(print_of)
        before, now = now, written(_star(_star(now, True), False), label)
        discard(before)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
