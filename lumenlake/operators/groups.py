"""Duplicate groups: fingerprints, ties by blocking on their parts, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a fingerprint, and the parts it is blocked by: prints that differ in at most PARTS - 1 bits share a part.
BITS, PARTS = 60, 5


def fingerprints(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, p: a 60-bit similarity print of each row's text: each bit is what most of the distinct words' hashes have there.

    A word is hashed once and its bits are summed by key, before the shuffle where Spark can. Null texts and texts without a
    word have a null print; keys are taken to be unique (rows that share one are read as one text); an empty table gives none."""
    word = F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))))
    hashed = rows.select(key, word.alias("w")).select(key, F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, BITS // 4), 16, 10).cast("long").alias("h"))
    sums = hashed.groupBy(key).agg(F.count("h").alias("n"), *(F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(BITS)))
    bits = sum((F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(1, BITS)), F.when(2 * F.col("b0") > F.col("n"), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return sums.select(key, F.when(F.col("n") > 0, bits).alias("p"))


def exact_ties(rows: DataFrame, key: str, value: str) -> DataFrame:
    """a, b: every row of a value tied to the smallest key that has it. A star, never all pairs of a group."""
    least = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(key).alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return least.join(rows.select(value, F.col(key).alias("b")), value).where("a < b").select("a", "b")


def near_ties(rows: DataFrame, key: str, prints: str, bits: int = PARTS - 1) -> DataFrame:
    """a, b: pairs of different prints no more than `bits` (below PARTS) apart, each by its smallest key."""
    if bits >= PARTS:
        raise ValueError(f"prints are blocked for fewer than {PARTS} bits")
    width = BITS // PARTS
    one = rows.where(F.col(prints).isNotNull()).groupBy(prints).agg(F.min(key).alias("k"))
    parts = F.array(*(F.shiftright(F.col(prints), i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(PARTS)))
    cut = one.select("k", F.col(prints).alias("p"), F.posexplode(parts).alias("part", "value"))
    other = cut.select(F.col("k").alias("k2"), F.col("p").alias("p2"), "part", "value")
    close = F.bit_count(F.col("p").bitwiseXOR(F.col("p2"))) <= bits
    return cut.join(other, ["part", "value"]).where((F.col("k") < F.col("k2")) & close).select(F.col("k").alias("a"), F.col("k2").alias("b")).distinct()


def shared_path(spark: SparkSession) -> str:
    """A fresh name in the folder of spark.checkpoint.dir, which all machines share. Where that is unset, a temporary folder in
    local mode; on a cluster an error, for a machine's own folder would lose data."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="lumenlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the folder that all machines share and read again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(ties: DataFrame) -> DataFrame:
    """node, group_id: the smallest node reachable by ties (a, b).

    Labels fall to the least of the neighbours' labels, then to their label's own label, so chains halve each round; every
    round is a written table, which cuts lineage and survives lost executors."""
    both = written(ties.select("a", "b").union(ties.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_a")).agg(F.min("label").alias("_least"))
        lower = labels.join(seen, F.col("node") == F.col("_a")).select("node", F.col("label").alias("old"), F.least("label", "_least").alias("label"))
        hop = lower.select(F.col("node").alias("_h"), F.col("label").alias("_next"))
        fresh = written(lower.join(hop, F.col("label") == F.col("_h"), "left").select("node", "old", F.least("label", F.coalesce("_next", "label")).alias("label")))
        labels = fresh.drop("old")
        if fresh.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "group_id")


def kinds(ties: DataFrame, loosest: int) -> DataFrame:
    """node, group_id, kind: components of ties (a, b, kind: 0 is the tightest), and of each group the loosest kind of tie it
    cannot do without: the least kind at which its nodes are one group without any looser tie. Null ends tie nothing."""
    ties = written(ties.where("a is not null and b is not null"))
    whole = components(ties)
    found = whole.withColumn("kind", F.lit(loosest))
    for level in range(loosest - 1, -1, -1):
        part = components(ties.where(F.col("kind") <= level)).withColumnRenamed("group_id", "at")
        one = whole.join(part, "node", "left").groupBy("group_id").agg((F.count_distinct(F.coalesce("at", "node")) == 1).alias("one"))
        found = found.join(one, "group_id").withColumn("kind", F.when(F.col("one"), F.lit(level)).otherwise(F.col("kind"))).drop("one")
    return found.select("node", "group_id", "kind")
