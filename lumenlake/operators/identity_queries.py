"""Registered queries over faces: the embeddings serve as faces by a fixed rule, each query beside its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import identity
from lumenlake.operators.registry import QUERIES, _query, _t

_FACES = """f AS (SELECT vec_id AS face, vec_id // 4 AS medium, embedding AS vector, CAST(vec_id * 37 % 160 AS BIGINT) AS pixels, (vec_id * 13 % 50) / 50.0 AS score, CASE WHEN vec_id % 3 > 0 THEN CAST(label AS BIGINT) END AS person,
CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN 'user' ELSE 'auto' END AS assigned_by, vec_id % 2 = 0 AS trusted, CASE WHEN vec_id % 3 = 0 THEN CAST(label AS BIGINT) END AS suggested, (vec_id * 7 % 40) / 100.0 AS distance FROM embeddings)"""
_GOOD = "coalesce(pixels >= 80 AND score >= 0.75, false)"
_D = lambda a, b: f"round(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"
_V = "CAST(vector AS DOUBLE[])"


def _faces(spark, sf):
    v, label = F.col("vec_id"), F.col("label").cast("long")
    named = v % 3 > 0
    by = F.when(~named, None).when(v % 5 == 0, "user").otherwise("auto")
    return _t(spark, sf, "embeddings").select(
        v.alias("face"), F.floor(v / 4).alias("medium"), F.col("embedding").alias("vector"), (v * 37 % 160).alias("pixels"), ((v * 13 % 50) / 50.0).alias("score"), F.when(named, label).alias("person"),
        by.alias("assigned_by"), (v % 2 == 0).alias("trusted"), F.when(~named, label).alias("suggested"), ((v * 7 % 40) / 100.0).alias("distance"),
    )


@_query(f"WITH {_FACES} SELECT face, person FROM f WHERE person IS NOT NULL AND (assigned_by = 'user' OR (trusted AND {_GOOD}))")
def vouching_faces(spark, sf):
    return identity.vouching(_faces(spark, sf)).select("face", "person")


_MIDDLES = """m AS (SELECT person, list(middle ORDER BY pos) AS middle FROM (SELECT person, pos, round(avg(x), 6) AS middle FROM (SELECT person, unnest(range(len(vector))) AS pos, CAST(unnest(vector) AS DOUBLE) AS x FROM f WHERE person IS NOT NULL) GROUP BY 1, 2) GROUP BY 1)"""


@_query(f"""WITH {_FACES}, {_MIDDLES}, d AS (SELECT face, medium, pixels, score, m.person, {_D(_V, 'middle')} AS distance FROM f, m WHERE f.person IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY distance, person) AS r FROM d WHERE distance <= 0.62 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.medium = d.medium AND g.person = d.person) AND NOT (face % 6 = 0 AND person = face % 10))
SELECT face, person, distance, CASE WHEN distance <= 0.30 AND {_GOOD} THEN 'trusted' WHEN distance <= CASE WHEN {_GOOD} THEN 0.45 ELSE 0.40 END THEN 'auto' ELSE 'suggested' END AS outcome FROM o WHERE r = 1""")
def assign_faces(spark, sf):
    f = _faces(spark, sf)
    each = f.where("person is not null").select("person", F.posexplode("vector").alias("pos", "x")).groupBy("person", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("middle"))
    middle = each.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "middle"))), lambda x: x["middle"]).alias("middle"))
    return identity.assigned(f, middle, f.where("face % 6 = 0").select("face", (F.col("face") % 10).alias("person")))


@_query(f"""WITH {_FACES}, a AS (SELECT *, CASE WHEN person IS NOT NULL AND row_number() OVER (PARTITION BY medium, person ORDER BY coalesce(assigned_by = 'user', false) DESC, pixels * score DESC, face) = 1 THEN person END AS p FROM f),
b AS (SELECT *, CASE WHEN p IS NULL AND NOT EXISTS (SELECT 1 FROM a o WHERE o.medium = a.medium AND o.p = a.suggested) THEN suggested END AS s FROM a)
SELECT face, p AS person, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY medium, s ORDER BY distance, pixels * score DESC, face) = 1 THEN s END AS suggested FROM b""")
def collapse_whole(spark, sf):
    return identity.collapsed(_faces(spark, sf)).select("face", "person", "suggested")


@_query(f"""WITH {_FACES}, e AS (SELECT person, count(*) AS faces, count(DISTINCT medium) AS media, first(face ORDER BY pixels * score DESC, face) AS cover FROM f WHERE person IS NOT NULL AND medium % 5 > 0 GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS person, coalesce(faces, 0) AS faces, coalesce(media, 0) AS media, cover FROM nation LEFT JOIN e ON person = n_nationkey""")
def persons_listed(spark, sf):
    f = _faces(spark, sf)
    return identity.persons(_t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("person")), f, f.where("medium % 5 > 0"))


@_query(f"WITH {_FACES} SELECT face FROM f WHERE EXISTS (SELECT 1 FROM f g WHERE g.medium = f.medium AND g.person = f.person AND g.face <> f.face)")
def faces_twice(spark, sf):
    return identity.twice(_faces(spark, sf)).select("face")


@_query(f"WITH {_FACES}, o AS (SELECT vector AS own FROM f WHERE face = 1), d AS (SELECT face, {_D(_V, 'CAST(own AS DOUBLE[])')} AS distance FROM f, o WHERE suggested = 3 AND person IS NULL AND face <> 1) SELECT face, distance FROM (SELECT * FROM d ORDER BY distance, face LIMIT 30) WHERE distance <= 1.0")
def alike_questions(spark, sf):
    return identity.alike(_faces(spark, sf), 1, 3, 1.0, 30)


@_query(f"WITH {_FACES} SELECT a.medium, a.face AS a, b.face AS b, {_D('CAST(a.vector AS DOUBLE[])', 'CAST(b.vector AS DOUBLE[])')} AS distance FROM f a JOIN f b ON a.medium = b.medium AND a.face < b.face WHERE {_D('CAST(a.vector AS DOUBLE[])', 'CAST(b.vector AS DOUBLE[])')} <= 0.9")
def near_pairs(spark, sf):
    return identity.near_pairs(_faces(spark, sf), "medium", "face", "vector", 0.9)


def faces_once(spark, sf):
    return identity.once_each(_faces(spark, sf).withColumn("medium", F.floor(F.col("face") / 20)), "medium", 0.1)


def person_middles(spark, sf):
    return identity.middles(identity.vouching(_faces(spark, sf)), "person")


# Greedy choices and k-means have no SQL: tests/test_identity.py holds them against plain Python.
QUERIES.update(faces_once=faces_once, person_middles=person_middles)
