"""Registered queries over the whole search and the gazetteer; the library is made of the tables by fixed rules, beside the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import finder, gazetteer, postings, trigrams
from lumenlake.operators.groups import shared_path
from lumenlake.operators.index_queries import _texts
from lumenlake.operators.registry import QUERIES, _query, _t

_LETTERS = ("0123456789_#", "abcdefghij  ")
_SPELL = lambda c: f"translate({c}, '{_LETTERS[0]}', '{_LETTERS[1]}')"
_ASK = "Fotos mit Asia und Middle East in Nation b Januar 2024"
_MEDIA = """m AS (SELECT event_id AS key, ts AS taken_at, CASE event_type WHEN 'view' THEN 'video' ELSE 'image' END AS kind, 'a' || user_id % 3 || '/b' || user_id % 7 AS album, CASE WHEN user_id % 4 > 0 THEN 'Make' || user_id % 2 END AS make, CASE WHEN user_id % 5 > 0 THEN 'M' || event_id % 3 END AS model,
CASE WHEN event_id % 6 > 0 THEN user_id % 4 END AS place, CASE WHEN event_id % 13 = 0 THEN 'missing' ELSE 'active' END AS status, CASE WHEN event_id % 17 = 0 THEN event_id - 1 END AS copy_of FROM events),
s AS (SELECT m.* FROM m WHERE status = 'active' AND copy_of IS NULL AND kind = 'image' AND taken_at >= TIMESTAMP '2024-01-01' AND taken_at < TIMESTAMP '2024-02-01' AND place = 1 AND key % 5 IN (2, 4) AND (key % 7 = 2 OR key % 7 = 4) AND list_contains([key % 5, key % 7], 2) AND list_contains([key % 5, key % 7], 4)),
w AS (SELECT key, taken_at, row_number() OVER (ORDER BY taken_at DESC, key) AS place FROM s ORDER BY place LIMIT 800)"""


def _library(spark, sf, words=None, names=None):
    e, key, user = _t(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    s = lambda c: c.cast("string")
    media = e.select(
        key.alias("key"), F.col("ts").alias("taken_at"), F.when(F.col("event_type") == "view", "video").otherwise("image").alias("kind"), text("a", s(user % 3), "/b", s(user % 7)).alias("album"),
        F.when(user % 4 > 0, text("Make", s(user % 2))).alias("make"), F.when(user % 5 > 0, text("M", s(key % 3))).alias("model"), F.when(key % 6 > 0, user % 4).alias("place"),
        F.when(key % 13 == 0, "missing").otherwise("active").alias("status"), F.when(key % 17 == 0, key - 1).alias("copy_of"),
    )
    nation = F.translate("n_name", *_LETTERS)
    places = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), nation.alias("name"), F.lit("Land").alias("country"), F.array(F.lower(nation)).alias("keys"))
    faces = e.select(key.alias("medium"), F.explode(F.array(key % 5, key % 7)).alias("person"))
    people = _t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("person"), F.col("r_name").alias("name"), (F.col("r_regionkey") == 0).alias("hidden"))
    pictures = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    told = _t(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    return finder.Library(media, places, faces, people, pictures, told, words, names, {"documents": 1.0, "turns": 0.9, "parts": 0.5})


@_query(f"WITH {_MEDIA} SELECT key, 0.0::DOUBLE AS score, place FROM w WHERE place > 5 ORDER BY place LIMIT 10")
def find_page(spark, sf):
    """The second page of the media with two persons, a place, a kind and a month."""
    return finder.find(_library(spark, sf), _ASK, offset=5, limit=10).page.select("key", "score", "place")


@_query(f"""WITH {_MEDIA}, f AS (SELECT m.*, {_SPELL('n_name')} AS town FROM m JOIN w USING (key) LEFT JOIN nation ON n_nationkey = m.place),
c AS (SELECT 'year' AS facet, CAST(year(taken_at) AS VARCHAR) AS value, CAST(year(taken_at) AS VARCHAR) AS label FROM f UNION ALL SELECT 'camera', trim(coalesce(make, '') || ' ' || model), trim(coalesce(make, '') || ' ' || model) FROM f
UNION ALL SELECT 'town', town, town || ', Land' FROM f UNION ALL SELECT 'album', album, album FROM f)
SELECT facet, value, label, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY facet, value, label QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value, label) <= 40""")
def find_facets(spark, sf):
    return finder.find(_library(spark, sf), _ASK).facets


@_query(f"WITH {_MEDIA} SELECT key FROM m WHERE status = 'active' AND copy_of IS NULL AND taken_at >= TIMESTAMP '2024-01-05' AND kind = 'image' AND (album = 'a1' OR starts_with(album, 'a1/')) AND trim(coalesce(make, '') || ' ' || model) = 'Make1 M2' AND place IN (1, 2) AND (key % 5 = 3 OR key % 7 = 3)")
def media_filtered(spark, sf):
    f = finder.Filters(since="2024-01-05", kind="image", album="a1", camera="Make1 M2", keys=("nation b", "nation c", "nowhere"), persons=(3,))
    return finder.filtered(_library(spark, sf), f).select("key")


def find_words(spark, sf):
    """Words, pictures and names of a place's media under one rank, the newest first."""
    parts = _t(spark, sf, "part")
    library = _library(spark, sf, postings.build(_texts(spark, sf)), trigrams.build(parts, "p_partkey", ["p_name"]))
    return finder.find(library, "red widget the in Nation b", probe=[1.0 if i % 3 == 0 else -0.5 for i in range(64)], by_date=True).hits


_TSV = f"""g AS (SELECT s_suppkey AS id, {_SPELL('s_name')} AS name, s_nationkey, s_suppkey * 10 AS population FROM supplier WHERE s_suppkey % 9 > 0),
a AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'kurz ' || {_SPELL("CAST(id AS VARCHAR)")} WHEN id % 3 = 1 THEN 'vor ' || {_SPELL("CAST(id AS VARCHAR)")} END AS own FROM g)"""


def _tables(spark, sf):
    """The four tables as GeoNames would publish them, made of supplier, nation and region; files in the shared folder."""
    at, sup = shared_path(spark), _t(spark, sf, "supplier")
    text = lambda *cols: F.concat_ws("\t", *(c.cast("string") if not isinstance(c, str) else F.lit(c) for c in cols))
    spell = lambda c: F.translate(c.cast("string"), *_LETTERS)
    key, nation, region = F.col("s_suppkey"), F.col("n_nationkey"), F.col("r_regionkey")
    name = spell(F.col("s_name"))
    lines = {
        "cities": sup.select(text(key, name, name, F.concat(name, F.lit(",Москва,x,Q1")), key / 7, key / 9, "P", F.when(key % 9 == 0, "PPLX").otherwise("PPL"), spell(F.col("s_nationkey")), "", F.lit("R"), "", "", "", key * 10)),
        "countries": _t(spark, sf, "nation").select(text(spell(nation), "", "", "", spell(F.col("n_name")), *[""] * 11, F.lit(1_000_000) + nation)).union(spark.range(1).select(F.lit("# comment"))),
        "regions": _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == region).select(text(F.concat(spell(nation), F.lit(".R")), F.col("r_name"), F.lower("r_name"), F.lit(2_000_000) + nation)),
        "alternates": sup.select(F.explode(F.array(text(key * 3, key, "de", F.concat(F.lit("vor "), spell(key)), F.when(key % 3 == 1, "1").otherwise(""), "", F.when(key % 3 == 2, "1").otherwise(""), ""), text(key * 3 + 1, key, "de", F.concat(F.lit("kurz "), spell(key)), "", "1", F.when(key % 3 > 0, "1").otherwise(""), ""), text(key * 3 + 2, key, "en", "other", "1", "1", "", "")))),
    }
    for table, rows in lines.items():
        rows.toDF("value").write.text(f"{at}/{table}")
    read = lambda t, columns: gazetteer.table(spark, f"{at}/{t}", columns)
    return read("cities", gazetteer.CITIES), read("regions", gazetteer.REGIONS), read("countries", gazetteer.COUNTRIES), read("alternates", gazetteer.ALTERNATES)


@_query(f"""WITH {_TSV} SELECT id, coalesce(own, g.name) AS name, r_name AS region, {_SPELL('n_name')} AS country, {_SPELL("CAST(s_nationkey AS VARCHAR)")} AS country_code, population, round(id / 7, 6) AS latitude, round(id / 9, 6) AS longitude,
array_to_string(list_sort(list_distinct(list_filter([lower(g.name), lower(own), lower(r_name), lower({_SPELL('n_name')})], lambda k: k IS NOT NULL AND length(k) >= 3))), '|') AS keys
FROM g JOIN a USING (id) JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def gazetteer_built(spark, sf):
    """The gazetteer read, built, written in its prepared form and read again."""
    at = shared_path(spark)
    gazetteer.write(gazetteer.build(*_tables(spark, sf)), at)
    back = gazetteer.read(spark, at)
    return back.withColumns({"keys": F.array_join("keys", "|"), "latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})


# A search by words has no SQL here: tests/test_finder.py holds its parts against plain Python.
QUERIES["find_words"] = find_words
