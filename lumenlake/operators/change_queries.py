"""Registered queries over folders, versions of tables and decisions about faces, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import decisions, refresh
from lumenlake.operators.groups import shared_path
from lumenlake.operators.identity_queries import _FACES, _faces
from lumenlake.operators.registry import _query, _t
from lumenlake.sources.folders import FolderSource


@_query("""WITH e AS (SELECT DISTINCT 'kind=' || event_type AS kind, 'part=' || user_id % 5 AS part FROM events)
SELECT '' AS folder, '(none)' AS parent, 0 AS files UNION ALL SELECT DISTINCT kind, '', 0 FROM e UNION ALL SELECT kind || '/' || part, kind, 1 FROM e WHERE kind || '/' || part <> 'kind=error/part=2'""")
def folder_walk(spark, sf):
    """Events written to folders by kind and part, and walked; one folder is left out."""
    at = shared_path(spark)
    events = _t(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("part"), "event_id")
    events.repartition("kind", "part").write.partitionBy("kind", "part").parquet(at)
    spark.dataSource.register(FolderSource)
    walked = spark.read.format("folders").options(path=at, endings="parquet", excluded="kind=error/part=2").load()
    return walked.where("file is null").select("folder", F.coalesce("parent", F.lit("(none)")).alias("parent"), "files")


@_query("SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1 UNION ALL SELECT -o_orderkey, 1 FROM orders WHERE o_orderdate < DATE '1993-01-01'")
def tables_refreshed(spark, sf):
    """A table put in place of another, rows appended to it, and all of it read by the manifest."""
    base, o = shared_path(spark), _t(spark, sf, "orders")
    count = lambda since: o.where(F.col("o_orderdate") >= F.lit(since).cast("date")).groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    refresh.refreshed(spark, base, {"counts": count("1990-01-01"), "log": o.select("o_orderkey")})
    refresh.refreshed(spark, base, {"counts": count("1996-01-01")})
    refresh.appended(spark, base, {"counts": o.where("o_orderdate < DATE '1993-01-01'").select((-F.col("o_orderkey")).alias("key"), F.lit(1).cast("long").alias("n"))})
    return refresh.current(spark, base, "counts")


_ANSWERS = "a AS (SELECT face, suggested + CASE WHEN face % 7 = 0 THEN 1 ELSE 0 END AS person, face % 2 = 0 AS yes FROM f WHERE face % 4 > 0), ok AS (SELECT f.face, yes FROM f JOIN a ON a.face = f.face AND a.person = f.suggested WHERE f.person IS NULL)"


@_query(f"WITH {_FACES}, {_ANSWERS} SELECT f.face, CASE WHEN yes THEN suggested ELSE person END AS person, CASE WHEN yes THEN 'user' WHEN NOT yes THEN NULL ELSE assigned_by END AS assigned_by, CASE WHEN yes IS NULL THEN suggested END AS suggested, CASE WHEN NOT yes THEN false ELSE trusted END AS trusted FROM f LEFT JOIN ok ON ok.face = f.face")
def questions_answered(spark, sf):
    f = _faces(spark, sf)
    says = f.where("face % 4 > 0").select("face", (F.col("suggested") + F.when(F.col("face") % 7 == 0, 1).otherwise(0)).alias("person"), (F.col("face") % 2 == 0).alias("yes"))
    after = decisions.answered(f, f.where("1 = 0").select("face", "person"), says)[0]
    return after.select("face", "person", "assigned_by", "suggested", "trusted")


@_query(f"WITH {_FACES}, t AS (SELECT * FROM (VALUES (1, 9), (2, 9), (4, 9), (8, 9), (3, 5)) v(source, target)) SELECT face, coalesce(p.target, person) AS person, coalesce(s.target, suggested) AS suggested FROM f LEFT JOIN t p ON p.source = person LEFT JOIN t s ON s.source = suggested")
def persons_merged(spark, sf):
    people = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("person"), F.col("n_name").alias("name"))
    pairs = people.where("person IN (1, 2, 4, 8, 3)").select(F.col("person").alias("source"), F.when(F.col("person") == 3, 5).when(F.col("person") == 8, 9).otherwise(2 * F.col("person")).alias("target"))
    return decisions.merged(_faces(spark, sf), people, pairs)[0].select("face", "person", "suggested")
