"""Registered queries of the search by words, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import fulltext, search
from lumenlake.operators.registry import _Q, VECTOR, _query, _t

_PAD = "' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '  ') || ' '"
_N = lambda w: f"CAST(floor((length(p) - length(replace(p, ' {w} ', ''))) / {len(w) + 2}) AS INT)"
_PHRASE = 'la "de la" -des OR viou'
_FITS = f"(({_N('la')} > 0 AND {_N('de  la')} > 0 AND {_N('des')} = 0) OR {_N('viou')} > 0)"
_HITS = f"({_N('la')} + {_N('de  la')} + {_N('viou')})"
_WORDS = f"""s AS (SELECT doc_id AS key, NULL AS moment, text, 1.0 AS weight FROM documents UNION ALL SELECT conv_id, turn, text, 0.9 FROM conversations UNION ALL SELECT p_partkey, NULL, p_name, 0.5 FROM part),
h AS (SELECT key, moment, round(weight * ln(1 + {_HITS}), 6) AS score FROM (SELECT *, {_PAD} AS p FROM s) WHERE {_FITS}),
w AS (SELECT key, score, moment, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, moment NULLS LAST) AS r FROM h) WHERE r = 1 ORDER BY score DESC, key LIMIT 200)"""


def _sources(spark, sf):
    c, none = _t(spark, sf, "conversations"), F.lit(None).alias("moment")
    return [(1.0, _t(spark, sf, "documents").select(F.col("doc_id").alias("key"), none, "text")), (0.9, c.select(F.col("conv_id").alias("key"), F.col("turn").alias("moment"), "text")), (0.5, _t(spark, sf, "part").select(F.col("p_partkey").alias("key"), none, F.col("p_name").alias("text")))]


@_query(f"WITH d AS (SELECT doc_id, {_PAD} AS p FROM documents) SELECT doc_id, {_HITS} AS hits FROM d WHERE {_FITS}")
def phrase_search(spark, sf):
    fits, hits = fulltext.matches(F.col("text"), _PHRASE)
    return _t(spark, sf, "documents").where(fits).select("doc_id", hits.alias("hits"))


@_query(f"WITH {_WORDS} SELECT key, score, moment, rank FROM w")
def words_of_sources(spark, sf):
    return fulltext.found_in(_sources(spark, sf), _PHRASE)


_GRAMS = lambda x: f"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_NAMES = f"n AS (SELECT p_partkey AS key, round(len(list_intersect({_GRAMS(chr(39) + 'red wiget' + chr(39))}, {_GRAMS('p_name')})) / len({_GRAMS(chr(39) + 'red wiget' + chr(39))}), 6) AS likeness FROM part)"


@_query(f"WITH {_NAMES} SELECT key, likeness FROM n WHERE likeness >= 0.5 ORDER BY likeness DESC, key LIMIT 200")
def names_like(spark, sf):
    return fulltext.names(_t(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_name"), "key", ["p_name"], "red wiget")


_NEAR = f"""v AS (SELECT vec_id AS key, round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), {_Q}::DOUBLE[]) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product({_Q}::DOUBLE[], {_Q}::DOUBLE[]))), 6) AS distance FROM embeddings),
p AS (SELECT key, row_number() OVER (ORDER BY distance, key) AS rank FROM (SELECT * FROM v ORDER BY distance, key LIMIT 200) WHERE distance <= 0.92)"""
_FUSED = """u AS (SELECT key, rank, CAST(moment AS BIGINT) AS moment, 'words' AS l FROM w UNION ALL SELECT key, rank, NULL, 'picture' FROM p),
g AS (SELECT key, round(sum(1.0 / (60 + rank)), 9) AS score, first(moment ORDER BY rank, moment) FILTER (WHERE moment IS NOT NULL) AS moment, bool_and(l = 'picture') AS alone, min(rank) AS best FROM u GROUP BY 1)"""


@_query(f"WITH {_NEAR} SELECT key, rank FROM p")
def picture_list(spark, sf):
    from pyspark.sql import Window as W

    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return search.nearest(e, "key", "embedding", VECTOR, 200).where("distance <= 0.92").select("key", F.row_number().over(W.orderBy("distance", "key")).alias("rank"))


@_query(f"WITH {_WORDS}, {_NEAR}, {_FUSED} SELECT key, score, moment FROM g WHERE NOT alone OR (best <= 20 AND key NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IS NOT NULL))")
def fused_search(spark, sf):
    told = _t(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("key"))
    none = F.lit(None).cast("long").alias("moment")
    return fulltext.fused({"words": fulltext.found_in(_sources(spark, sf), _PHRASE), "picture": picture_list(spark, sf).select("key", "rank", none)}, told)


@_query(f"""WITH keep AS (SELECT event_id AS key FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' AND event_type = 'click'),
{_WORDS.replace("FROM documents", "FROM documents WHERE doc_id IN (FROM keep)").replace("FROM conversations", "FROM conversations WHERE conv_id IN (FROM keep)").replace("FROM part)", "FROM part WHERE p_partkey IN (FROM keep))")},
{_NEAR.replace("FROM embeddings", "FROM embeddings WHERE vec_id IN (FROM keep)")}, {_FUSED}
SELECT key, score, moment FROM g WHERE NOT alone OR (best <= 20 AND key NOT IN (SELECT doc_id FROM documents WHERE text IS NOT NULL))""")
def find_whole(spark, sf):
    e = _t(spark, sf, "events")
    media = e.select(F.col("event_id").alias("key"), F.col("ts").alias("at"), F.lit("image").alias("kind"), F.col("event_type").alias("person"), F.lit(None).cast("string").alias("name"))
    pictures = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    people = e.select(F.col("event_type").alias("name")).distinct()
    return fulltext.find(f"Fotos mit Click Januar 2024 {_PHRASE}", _sources(spark, sf), media, pictures, VECTOR, people)[1]
