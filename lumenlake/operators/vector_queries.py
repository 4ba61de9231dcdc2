"""Registered queries over the vector index: neighbours, names and groups of faces, motifs, each beside its SQL where it has one.

The embeddings are drawn towards one of fifty directions by a fixed rule, so that there is something to find in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import identity, motifs, search, unknown, vectors
from lumenlake.operators.groups import written
from lumenlake.operators.identity_queries import _D, _FACES, _GOOD, _faces
from lumenlake.operators.registry import QUERIES, _query, _t

_PULL = {"faces": 1.2, "pictures": 2.0}
_V = lambda pull: f"list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + CASE WHEN i = CAST(label AS BIGINT) * 5 + vec_id % 5 + 1 THEN {pull} ELSE 0.0 END)"


def _pulled(spark, sf, pull):
    e = _t(spark, sf, "embeddings")
    at = F.col("label").cast("long") * 5 + F.col("vec_id") % 5
    return e.select("vec_id", "label", F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == at, F.lit(pull)).otherwise(0.0)).alias("vector"))


def _looks(spark, sf):
    """The faces of identity_queries with vectors that are drawn together."""
    return _faces(spark, sf).drop("vector").join(_pulled(spark, sf, _PULL["faces"]).select(F.col("vec_id").alias("face"), "vector"), "face")


_LOOKS = f"{_FACES}, v AS (SELECT vec_id AS face, {_V(_PULL['faces'])} AS vector FROM embeddings), k AS (SELECT f.* EXCLUDE (vector), v.vector FROM f JOIN v USING (face))"


@_query(f"WITH v AS (SELECT vec_id, {_V(_PULL['pictures'])} AS vector FROM embeddings), d AS (SELECT v.vec_id, {_D('v.vector', 'o.vector')} AS distance FROM v, v o WHERE o.vec_id = 7) SELECT vec_id, distance FROM d WHERE distance <= 0.6 ORDER BY distance, vec_id LIMIT 30")
def near_to(spark, sf):
    rows = written(_pulled(spark, sf, _PULL["pictures"]))
    own = rows.where("vec_id = 7").select("vector").first()[0]  # one row
    return vectors.near(vectors.build(rows, "vec_id", "vector"), own, 0.6, 30)[0]


@_query(f"""WITH {_LOOKS}, d AS (SELECT a.face AS question, b.face AS found, {_D('a.vector', 'b.vector')} AS distance FROM k a JOIN k b ON a.face <> b.face WHERE b.person IS NULL AND coalesce(b.pixels >= 80 AND b.score >= 0.5, false))
SELECT * FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY question ORDER BY distance, found) <= 10) WHERE distance <= 0.7""")
def face_neighbours(spark, sf):
    f = _looks(spark, sf)
    index = vectors.build(f, "face", "vector", keep=["person", "pixels", "score"])
    return vectors.neighbours(index, f, "face", "vector", 0.7, 10, itself=False, where=F.col("person").isNull() & identity.good(F.col("pixels"), F.col("score"), 80, 0.5))


@_query(f"""WITH {_LOOKS}, m AS (SELECT person, list(middle ORDER BY pos) AS middle FROM (SELECT person, pos, round(avg(x), 6) AS middle FROM (SELECT person, unnest(range(len(vector))) AS pos, unnest(vector) AS x FROM k WHERE person IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT * FROM k WHERE assigned_by IS DISTINCT FROM 'user'),
p AS (SELECT a.face, b.person, b.assigned_by = 'user' OR (b.trusted AND {_GOOD.replace('pixels', 'b.pixels').replace('score', 'b.score')}) AS vouches, b.face AS found, {_D('a.vector', 'b.vector')} AS distance FROM a JOIN k b ON b.person IS NOT NULL AND a.face <> b.face),
l AS (SELECT face, person, distance, 0 AS list FROM (SELECT * FROM p WHERE vouches QUALIFY row_number() OVER (PARTITION BY face ORDER BY distance, found) <= 10) WHERE distance <= 0.45
UNION ALL SELECT face, person, distance, 2 FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY face ORDER BY distance, found) <= 10) WHERE distance <= 0.62
UNION ALL SELECT face, person, distance, 1 FROM (SELECT a.face, m.person, {_D('a.vector', 'm.middle')} AS distance FROM a, m) WHERE distance <= 0.40 QUALIFY row_number() OVER (PARTITION BY face ORDER BY distance, person) <= 5),
o AS (SELECT l.*, pixels, score FROM l JOIN k USING (face) WHERE NOT EXISTS (SELECT 1 FROM k g WHERE g.medium = k.medium AND g.person = l.person AND g.face <> l.face) AND NOT (face % 6 = 0 AND l.person = face % 10) QUALIFY row_number() OVER (PARTITION BY face ORDER BY list, l.distance, l.person) = 1)
SELECT face, person, distance, CASE WHEN list = 2 THEN 'suggested' WHEN list = 0 AND distance <= 0.30 AND {_GOOD} THEN 'trusted' ELSE 'auto' END AS outcome FROM o""")
def name_faces(spark, sf):
    f = written(_looks(spark, sf))
    return identity.named(f, _middles(f), _rejected(f))


def _middles(f):
    each = search.middles(f.where("person is not null"), "person", "vector")
    return each.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "middle"))), lambda x: x["middle"]).alias("middle"))  # one entry for each dimension


def _rejected(f):
    return f.where("face % 6 = 0").select("face", (F.col("face") % 10).alias("person"))


def _bar():
    return identity.good(F.col("pixels"), F.col("score"), 40, 0.3)


def unknown_faces(spark, sf):
    return unknown.grouped(written(_looks(spark, sf)), bar=_bar())


def unknown_summary(spark, sf):
    f = written(_looks(spark, sf))
    return unknown.summary(unknown.grouped(f, bar=_bar()), f)


def reassess_faces(spark, sf):
    f = written(_looks(spark, sf))
    return unknown.reassessed(f, _middles(f), _rejected(f))


def motif_members(spark, sf):
    return motifs.motifs(written(_pulled(spark, sf, _PULL["pictures"])), "vec_id", "vector", wanted=20)


def motif_tags(spark, sf):
    e = written(_pulled(spark, sf, _PULL["pictures"]))
    tags = e.select(F.col("vec_id").alias("key"), F.explode(F.array(F.concat(F.lit("label "), F.col("label").cast("string")), F.concat(F.lit("shade "), (F.col("vec_id") % 5).cast("string")), F.concat(F.lit("day "), (F.col("vec_id") % 7).cast("string")))).alias("tag"))
    return motifs.tags_of(motifs.motifs(e, "vec_id", "vector", wanted=20), tags)


# Walks in an order have no SQL: tests/test_vectors.py holds them against plain Python.
QUERIES.update(unknown_faces=unknown_faces, unknown_summary=unknown_summary, reassess_faces=reassess_faces, motif_members=motif_members, motif_tags=motif_tags)
