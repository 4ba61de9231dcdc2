"""Snapshots compared, feeds merged, and the targets of notifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def compared(before: DataFrame, after: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """key, change: 'added', 'removed' or 'changed' (nulls are equal to nulls); one join on the key."""
    digest = F.struct(*values)
    both = before.select(key, digest.alias("_old")).join(after.select(key, digest.alias("_new")), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def settled(seen: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """key, stable_since: the first look at which a key had the value it has now, and has had since."""
    w = W.partitionBy(key).orderBy(time)
    moved = seen.withColumn("_moved", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1))
    return moved.where("_moved").groupBy(key).agg(F.max(time).alias("stable_since"))


def feed(sources: Sequence[tuple[str, DataFrame]], size: int) -> DataFrame:
    """kind, id, at of the newest rows of all sources, each with columns id and at; each source gives its own top alone."""
    tops = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col("at")).orderBy(F.desc("at"), "id").limit(size) for kind, df in sources]
    merged = tops[0]
    for t in tops[1:]:
        merged = merged.unionByName(t)
    return merged.orderBy(F.desc("at"), "kind", "id").limit(size)


def notified(reasons: Sequence[tuple[str, DataFrame]], actor: str) -> DataFrame:
    """event, person, reason: each person once per event, by the first reason that holds, never the actor."""
    parts = [df.select("event", "person", actor, F.lit(i).alias("_p"), F.lit(name).alias("reason")) for i, (name, df) in enumerate(reasons)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    best = merged.where(F.col("person") != F.col(actor)).groupBy("event", "person").agg(F.min(F.struct("_p", "reason")).alias("b"))
    return best.select("event", "person", F.col("b.reason").alias("reason"))
