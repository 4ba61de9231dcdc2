"""Likeness of words in a name: how well any stretch of a name's trigrams agrees with those of a query.

A name's words (letters and digits, in small letters) each give trigrams in order, with two blanks before and one after. Of all
stretches of these the one counts whose distinct trigrams have the highest Jaccard with the query's, so trigrams that stand
together count for more than the same ones scattered. Names without a word, null names and null keys are like nothing; names
that repeat are looked at once; a query without a word finds nothing; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.groups import written

LEAST, MOST = 0.5, 200


def ordered(name: Column) -> Column:
    """The trigrams of a name in order, repeats too."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))


def likeness(query: Column, grams: Column) -> Column:
    """The best Jaccard of the distinct trigrams of the query with those of a stretch of grams; 0 where they share none. Only
    stretches that begin and end with a trigram of the query can be the best."""
    hits = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(query, F.element_at(grams, i)))
    stretch = lambda i, j: F.array_distinct(F.slice(grams, i, j - i + 1))
    common = lambda s: F.size(F.array_intersect(query, s))
    jaccard = lambda s: common(s) / (F.size(query) + F.size(s) - common(s))
    pairs = F.flatten(F.transform(hits, lambda i: F.transform(F.filter(hits, lambda j: j >= i), lambda j: jaccard(stretch(i, j)))))
    return F.when(F.size(grams) > 0, F.coalesce(F.array_max(pairs), F.lit(0.0))).otherwise(0.0)


@dataclass
class Names:
    """Written tables: the distinct names (id, name), the rows that have them (id, key), and the postings (gram, id) in the order
    of the trigrams."""

    names: DataFrame
    rows: DataFrame
    postings: DataFrame


def build(rows: DataFrame, key: str, columns: list[str]) -> Names:
    """The index of the names in some columns of rows."""
    each = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("name")).where("name is not null")
    names = written(each.select("name").distinct().withColumn("id", F.monotonically_increasing_id()))
    have = written(each.join(names, "name").select("id", "key").distinct())
    grams = names.select(F.explode(F.array_distinct(ordered(F.col("name")))).alias("gram"), "id")
    return Names(names, have, written(grams.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")))


def alike(index: Names, query: str, least: float = LEAST, most: int | None = MOST) -> DataFrame:
    """key, likeness of the keys whose best name is like the query; the `most` best, ties by key.

    A likeness of `least` needs that share of the query's trigrams somewhere in the name: only names that the postings give that
    often are compared. Postings of other trigrams are not read."""
    spark = index.names.sparkSession
    grams = spark.range(1).select(F.array_distinct(ordered(F.lit(query)))).first()[0]  # the query's own
    found = index.postings.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least * len(grams))
    q = F.array(*(F.lit(g) for g in grams)).cast("array<string>")
    like = index.names.join(found, "id").select("id", F.round(likeness(q, ordered(F.col("name"))), 6).alias("likeness")).where((F.col("likeness") >= least) & (F.col("likeness") > 0))
    best = index.rows.join(like, "id").groupBy("key").agg(F.max("likeness").alias("likeness"))
    return best if most is None else best.orderBy(F.desc("likeness"), "key").limit(most)
