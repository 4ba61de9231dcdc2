"""Choosing rows: covers, newest and best ones, even stretches, neighbours, modes, distinctive terms, prototypes.

Unless a function says otherwise: rows whose group is null form a group of their own, ties go to the smallest key, rows that
repeat count each, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators import vectors as vectors_
from lumenlake.operators.groups import written


def first_of(rows: DataFrame, group: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in an order, with their place."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def most_common(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n: the value that most rows of a group have; null values do not count, ties go to the smallest value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(group).agg(F.max(F.struct("n")).alias("m"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))
    return best.select(group, value, F.col("m.n").alias("n"))


def even_stretches(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first row of each of n stretches of like length of each group; groups of up to n rows stay whole."""
    w = W.partitionBy(group)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_m", F.count(F.lit(1)).over(w))
    stretch = F.floor(F.col("_i") * n / F.col("_m"))
    before = F.floor((F.col("_i") - 1) * n / F.col("_m"))
    return numbered.where((F.col("_m") <= n) | (F.col("_i") == 0) | (stretch != before)).drop("_i", "_m")


def neighbours(rows: DataFrame, group: str, time: str, key: str) -> DataFrame:
    """Each row with the key before and after it in its group (null at the ends)."""
    w = W.partitionBy(group).orderBy(time, key)
    return rows.select(group, key, F.lag(key).over(w).alias("before"), F.lead(key).over(w).alias("after"))


def distinctive(rows: DataFrame, group: str, term: str, least_share: float, least: int, k: int) -> DataFrame:
    """group, term, n, score, place: the k terms of a group with the best share * ln(1 / share of the groups that have it).
    Terms need at least `least` rows and least_share of the group's rows. Null terms count towards the group only."""
    n = rows.groupBy(group, term).agg(F.count(F.lit(1)).alias("n"))
    whole = rows.groupBy(group).agg(F.count(F.lit(1)).alias("whole"))
    groups = whole.agg(F.count(F.lit(1)).alias("groups"))  # one row
    df = n.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    share = F.col("n") / F.col("whole")
    scored = n.where(F.col(term).isNotNull()).join(whole, group).join(df, term).crossJoin(F.broadcast(groups))
    scored = scored.where((F.col("n") >= least) & (share >= least_share)).select(group, term, "n", F.round(share * F.log(F.col("groups") / F.col("df")), 6).alias("score"))
    return first_of(scored, [group], [F.desc("score"), F.col(term)], k)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two tag arrays; 0 where both are empty, null where one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0))


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    """One row: groups, rows in them, size of the largest."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members"), F.max("n").alias("largest"))


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def prototype_neighbours(vectors: DataFrame, key: str, vector: str, prototypes: DataFrame, name: str, middle: str, radius: float, k: int) -> DataFrame:
    """key, name, distance, place: the k nearest prototypes within radius of each row, by an index of the prototypes. key is a
    whole number; rows without a vector, or with one of no length, have none."""
    numbered = written(prototypes.select(name, middle).withColumn("_id", F.monotonically_increasing_id()))
    pairs = vectors_.neighbours(vectors_.build(numbered, "_id", middle), vectors, key, vector, radius)
    named = pairs.join(numbered.select(F.col("_id").alias("found"), name), "found").select(F.col("question").alias(key), name, "distance")
    return first_of(named, [key], [F.col("distance"), F.col(name)], k)
