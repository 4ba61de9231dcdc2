"""Timeline walks, marks, sessions and bursts over tables with an id and a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keyset_page(rows: DataFrame, time: str, key: str, after: tuple | None, size: int, backwards: bool = False) -> DataFrame:
    """The next page in (time, key) order, newest first; after: (time, key) of the last row seen. A top-k, never a full sort."""
    order = [F.asc(time), F.asc(key)] if backwards else [F.desc(time), F.desc(key)]
    if after is not None:
        t, k = F.lit(after[0]).cast(rows.schema[time].dataType), F.lit(after[1])
        beyond = (F.col(time) > t) | ((F.col(time) == t) & (F.col(key) > k)) if backwards else (F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k))
        rows = rows.where(beyond)
    return rows.orderBy(*order).limit(size)


def marks(rows: DataFrame, time: str, unit: str) -> DataFrame:
    """mark, n, first_at: the rows of each year, month or day."""
    return rows.groupBy(F.date_trunc(unit, time).cast("date").alias("mark")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_at"))


def sessions(rows: DataFrame, by: str, time: str, gap_seconds: int) -> DataFrame:
    """by, start_at, end_at, n: islands of rows no more than gap_seconds apart."""
    w = W.partitionBy(by).orderBy(time)
    apart = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    island = F.sum((F.coalesce(apart, F.lit(0)) > gap_seconds * 1_000_000).cast("int")).over(w)
    return rows.withColumn("_island", island).groupBy(by, "_island").agg(F.min(time).alias("start_at"), F.max(time).alias("end_at"), F.count(F.lit(1)).alias("n")).drop("_island")


def burst_pairs(rows: DataFrame, by: str, key: str, time: str, seconds: int) -> DataFrame:
    """a, b: rows of one owner no more than `seconds` apart. Time buckets make it an equi-join on (owner, bucket)."""
    s = F.unix_micros(F.col(time).cast("timestamp"))
    width = seconds * 1_000_000
    left = rows.select(F.col(by).alias("o"), F.col(key).alias("a"), s.alias("at"), F.explode(F.array(*(F.floor(s / width) + i for i in (-1, 0, 1)))).alias("slot"))
    right = rows.select(F.col(by).alias("o"), F.col(key).alias("b"), s.alias("bt"), F.floor(s / width).alias("slot"))
    near = F.abs(F.col("at") - F.col("bt")) <= width
    return left.join(right, ["o", "slot"]).where(near & (F.col("a") < F.col("b"))).select("a", "b")


def arrivals(rows: DataFrame, time: str, by: str, seconds: int) -> DataFrame:
    """Each row's number of rows by the same owner in the `seconds` up to it."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    return rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(by).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)))
