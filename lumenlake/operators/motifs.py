"""Motifs: what a library is full of. Leaders in a shuffled order take the rows around them that no leader before them took.

Leaders are settled in rounds. One is ready when no open leader before it reaches any of the rows that it could take; what is
ready is settled at once, and the outcome is that of going through all leaders one after the other. Ties of the order go to
the smaller key; rows without a direction lead nothing and are taken by nobody; an empty table gives no motif.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators import vectors
from lumenlake.operators.groups import written
from lumenlake.operators.picks import first_of

# How alike the rows of a motif are, how many a leader asks for, how many make a motif.
ALIKE, ASKED, LEAST = 0.24, 1500, 8


def settled(reach: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(leader, first, member of each motif; leader, first, tried of all leaders) of reach: leader, first (a distinct text or number
    by which leaders are ordered), member.

    A leader whose open rows have become fewer than `least` can lead no more. tried is false for a leader that one before it
    had taken. Each round is a written table."""
    open_ = written(reach.select("leader", "first", "member").distinct())
    all_ = open_.select("leader", "first").distinct()
    won = None
    while True:
        sizes = open_.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("leader")
        open_ = open_.join(sizes, "leader", "left_semi")
        claim = open_.groupBy("member").agg(F.min("first").alias("_least"))
        marked = written(open_.join(claim, "member").withColumn("ready", F.min(F.col("_least") == F.col("first")).over(W.partitionBy("leader"))))
        if marked.isEmpty():
            break
        new = marked.where("ready").select("leader", "first", "member")
        won = new if won is None else won.unionByName(new)
        rest = marked.where("not ready").join(new.select("member"), "member", "left_anti").join(new.select(F.col("member").alias("leader")), "leader", "left_anti")
        open_ = written(rest.select("leader", "first", "member"))
    if won is None:
        return open_, all_.withColumn("tried", F.lit(True))
    won = written(won)
    taken = won.select(F.col("member").alias("leader"), F.col("first").alias("_by"))
    return won, all_.join(taken, "leader", "left").select("leader", "first", (F.col("_by").isNull() | (F.col("_by") >= F.col("first"))).alias("tried"))


def motifs(rows: DataFrame, key: str, vector: str, wanted: int, attempts: int = 400, seed: str = "", alike: float = ALIKE, least: int = LEAST, asked: int = ASKED) -> DataFrame:
    """leader, number, member of the first `wanted` motifs, numbered in their order, among the first `attempts` leaders that
    nobody before them had taken. Leaders come in the order of md5(key and seed).

    Only the first leaders ask the index: twice `attempts`, and four times as many while too few of them were tried. What comes
    later cannot change an earlier motif."""
    index = vectors.build(rows, key, vector)
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    some = index.table.select(key, vector, order.alias("first"))
    total, n = some.select(key).distinct().count(), 2 * attempts
    while True:
        leaders = written(some.dropDuplicates([key]).orderBy("first", key).limit(n))
        found = vectors.neighbours(index, leaders, key, vector, alike, asked)
        reach = found.join(leaders.select(F.col(key).alias("question"), F.concat_ws(" ", "first", F.lpad(F.col(key).cast("string"), 20, "0")).alias("first")), "question")
        won, all_ = settled(reach.select(F.col("question").alias("leader"), "first", F.col("found").alias("member")), least)
        tried = all_.where("tried").orderBy("first").limit(attempts).collect()  # `attempts` rows
        leads = {r["leader"] for r in won.join(all_.where("tried").orderBy("first").limit(attempts).select("leader"), "leader", "left_semi").select("leader").distinct().collect()}  # so are these
        chosen = [r["leader"] for r in sorted(tried, key=lambda r: r["first"]) if r["leader"] in leads][:wanted]
        if len(tried) >= attempts or len(chosen) >= wanted or n >= total:
            break
        n *= 4
    numbers = rows.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(chosen)], "leader bigint, number int")
    return won.join(F.broadcast(numbers), "leader").select("leader", "number", "member")


def tags_of(groups: DataFrame, tags: DataFrame, least_share: float = 0.30, k: int = 3) -> DataFrame:
    """leader, tag, n, score, place: the k tags that set a motif apart: share of its members times ln(1 / share of all rows with
    tags), for tags of at least least_share of the members. groups: leader, member; tags: key, tag; repeats count once."""
    each = tags.where("key is not null and tag is not null").select("key", "tag").distinct()
    total = each.agg(F.count_distinct("key").alias("total"))  # one row
    df = each.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    size = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    n = groups.join(each, F.col("member") == F.col("key")).groupBy("leader", "tag").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("size")
    scored = n.join(size, "leader").where(share >= least_share).join(df, "tag").crossJoin(F.broadcast(total))
    return first_of(scored.select("leader", "tag", "n", F.round(share * F.log(F.col("total") / F.col("df")), 6).alias("score")), ["leader"], [F.desc("score"), F.col("tag")], k)
