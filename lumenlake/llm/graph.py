"""Connected components of an edge table, by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C


def _settled(e: DataFrame) -> bool:
    """Whether every node is either a component's smallest one or tied to one such node only. A node's edges are counted
    before they are shuffled."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns node, component (the smallest node reachable) for every node with an edge to another.

    Each round writes its edges and the minima to the shared folder. Minima are pre-aggregated before they are shuffled, and
    they are joined from a table of their own, so that Spark can split the edges of a node with very many. Null ends and loops are ignored; an empty table gives no rows.
    """
    e = C.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(e):
            break
        # Large star: every larger neighbour of u moves to the smallest of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        least = C.stored(least, "least")
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = C.stored(large, "edges")
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        low = C.stored(low, "least")
        small = large.join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = C.stored(small.union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
    else:
        if not _settled(e):
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
