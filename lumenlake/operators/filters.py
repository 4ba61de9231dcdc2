"""Conditions and clocks: a bundle of filters, quiet hours, retention, fixed windows, trees of paths, names in texts.

Filters keep a row only where the condition is true: a null value never passes. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators.groups import written


@dataclass
class Bundle:
    """Conditions that all must hold; those left None do not count. since is inside, until is not."""

    since: str | None = None
    until: str | None = None
    kinds: list[str] | None = None
    below: str | None = None
    within: tuple[float, float] | None = None

    def column(self, time: str, kind: str, path: str, value: str) -> Column:
        parts = [F.lit(True)]
        if self.since:
            parts.append(F.col(time) >= F.lit(self.since).cast("timestamp"))
        if self.until:
            parts.append(F.col(time) < F.lit(self.until).cast("timestamp"))
        if self.kinds is not None:
            parts.append(F.col(kind).isin(self.kinds))
        if self.below is not None:
            parts.append(under(F.col(path), self.below))
        if self.within:
            parts.append(F.col(value).between(*self.within))
        return reduce(lambda a, b: a & b, parts)


def under(path: Column, top: str) -> Column:
    """Whether a path is `top` or lies below it; the empty top covers all."""
    return F.lit(True) if top == "" else (path == top) | F.startswith(path, F.lit(top + "/"))


def quiet(time: Column, start: int, end: int) -> Column:
    """Whether a time's minute of the day lies in [start, end), across midnight where start > end."""
    minute = F.hour(time) * 60 + F.minute(time)
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)


def kept_for(rows: DataFrame, time: str, days: int, key: str) -> DataFrame:
    """Rows no older than so many days before the newest one; rows without a time go."""
    newest = rows.agg(F.max(time).alias("_newest"))  # one row
    return rows.crossJoin(F.broadcast(newest)).where(F.col(time) >= F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")


def fixed_windows(rows: DataFrame, key: str, time: str, seconds: int, limit: int) -> DataFrame:
    """key, start_at, n, over: windows of fixed length for each key; over: whether more than limit rows fell in it."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(time) / seconds) * seconds)
    return rows.where(F.col(time).isNotNull()).groupBy(key, start.alias("start_at")).agg(F.count(F.lit(1)).alias("n")).withColumn("over", F.col("n") > limit)


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """node, ancestor, depth of a tree of parents, however deep, each node its own ancestor at depth 0. Each round doubles the steps
    that are known and is a written table; a node above itself raises an error. Null children are left out, repeats count once;
    a parent without a row of its own is an ancestor all the same."""
    up = written(edges.where(F.col(child).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct())
    known, reach = written(up.where("ancestor is not null").withColumn("depth", F.lit(1))), 1
    while True:
        if not known.where("node = ancestor").isEmpty():
            raise ValueError("a node lies above itself")
        far = known.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("_a"))
        on = known.select(F.col("node").alias("_a"), "ancestor", F.col("depth").alias("_d"))
        more = written(far.join(on, "_a").select("node", "ancestor", (F.col("_d") + reach).alias("depth")).distinct())
        if more.isEmpty():
            return known.unionByName(up.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct())
        known, reach = written(known.unionByName(more)), 2 * reach


def mentions(rows: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """key, name: the names a text calls by @name, each once; names that do not exist are not found."""
    called = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?:^|[^a-z0-9_@])@([a-z0-9_#]+)"), F.lit(1)))).alias("_name"))
    return called.join(names.select(F.col(name), F.lower(F.col(name)).alias("_name")).distinct(), "_name").select(key, name).distinct()


def unlike_repeats(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from that of the row before in their group (a null equals a null)."""
    w = W.partitionBy(group).orderBy(order)
    return rows.withColumn("_last", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col("_last").eqNullSafe(F.col(value))).drop("_last", "_first")
