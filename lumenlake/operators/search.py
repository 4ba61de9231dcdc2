"""Retrieval: nearest vectors, word and trigram matches, reciprocal rank fusion, facets and relational division."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    x = F.transform(vector, lambda v: v.cast("double"))
    q = F.array(*(F.lit(float(v)) for v in query))
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(x, q, lambda a, b: a * b), zero, lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(x, zero, lambda s, v: s + v * v)) * float(sum(v * v for v in map(float, query)) ** 0.5)
    return 1 - dot / norm


def nearest(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int, radius: float | None = None) -> DataFrame:
    """key, distance of the k nearest rows (within radius); one scan and a top-k."""
    d = vectors.select(key, F.round(cosine_distance(F.col(vector), query), 6).alias("distance"))
    return (d if radius is None else d.where(F.col("distance") <= radius)).orderBy("distance", key).limit(k)


def middles(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """group, pos, middle: the mean vector of each group, one row for each dimension; means are partly summed before they move."""
    return vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("middle"))


def _times(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word))


def words_and(docs: DataFrame, key: str, text: str, words: Sequence[str]) -> DataFrame:
    """key, hits: rows that hold all words; hits counts their occurrences."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    each = [_times("_t", w) for w in words]
    found = docs.select(key, tokens.alias("_t")).select(key, *(c.alias(f"_n{i}") for i, c in enumerate(each)))
    total = sum((F.col(f"_n{i}") for i in range(len(words))), F.lit(0))
    for i in range(len(words)):
        found = found.where(F.col(f"_n{i}") > 0)
    return found.select(key, total.cast("long").alias("hits"))


def trigrams(name: Column) -> Column:
    """Distinct trigrams of the words of a name, each with two blanks before and one after."""
    padded = F.transform(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similar_names(names: DataFrame, key: str, name: str, query: str, least: float) -> DataFrame:
    """key, similarity: the share of trigrams in common, for rows at or above `least`."""
    a, b = trigrams(F.col(name)), trigrams(F.lit(query))
    s = names.select(key, F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("similarity"))
    return s.where(F.col("similarity") >= least)


def fuse(lists: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists of key, rank: key, score."""
    parts = [x.select(key, (1.0 / (k + F.col("rank"))).alias("s")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy(key).agg(F.round(F.sum("s"), 9).alias("score"))


def ranked(rows: DataFrame, key: str, order: Column, most: int) -> DataFrame:
    """key, rank of the first `most` rows: the window runs over that bounded list alone."""
    top = rows.orderBy(order, key).limit(most)
    return top.select(key, F.row_number().over(W.orderBy(order, F.col(key))).alias("rank"))


def facets(rows: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """facet, value, n: the most frequent values of each column, in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    counted = rows.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("_r", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= most).drop("_r")


def all_of(links: DataFrame, owner: str, item: str, wanted: Sequence) -> DataFrame:
    """Owners linked with every wanted item."""
    hit = links.where(F.col(item).isin(list(wanted))).groupBy(owner).agg(F.count_distinct(item).alias("n"))
    return hit.where(F.col("n") == len(set(wanted))).select(owner)


def equal_groups(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """group_id, n: rows that hold the same value, two or more."""
    return rows.groupBy(F.sha2(value.cast("string"), 256).alias("_h")).agg(F.min(key).alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and _h is not null").drop("_h")


#: Rows of links that a task of together() pairs.
LINKS = 200_000


def together(links: DataFrame, owner: str, item: str, least: int) -> DataFrame:
    """a, b, n: items that share at least `least` owners. Owners are dealt to as many tasks as the links need, so that what one
    task sorts and counts does not grow with the input."""
    x = links.select(owner, item).where(F.col(owner).isNotNull() & F.col(item).isNotNull())
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-x.count() // LINKS))
    x = x.repartition(tasks, owner).distinct()
    pairs = x.select(owner, F.col(item).alias("a")).join(x.select(owner, F.col(item).alias("b")), owner).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
