"""Registered queries over small conditions and lists, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import conditions, filters, places, timeline
from lumenlake.operators.registry import _query, _t


@_query("SELECT s_suppkey FROM supplier WHERE s_acctbal / 100 BETWEEN -85.05 AND 85.05 AND ['exif', 'gps', 'filename', 'folder_name', 'file_mtime'][CAST(s_suppkey % 5 + 1 AS INT)] IN ('exif', 'gps', 'filename') AND NOT coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 2 = 0 END, false)")
def certain_on_map(spark, sf):
    s, k = _t(spark, sf, "supplier"), F.col("s_suppkey")
    source = F.element_at(F.array(*map(F.lit, ("exif", "gps", "filename", "folder_name", "file_mtime"))), (k % 5 + 1).cast("int"))
    return s.where(conditions.on_map(F.col("s_acctbal") / 100) & conditions.certain(source) & conditions.unless(F.when(k % 3 > 0, k % 2 == 0))).select("s_suppkey")


@_query("SELECT vec_id FROM embeddings WHERE vec_id * 37 % 160 >= 40 AND (vec_id * 13 % 50) / 50.0 >= 0.6")
def faces_admitted(spark, sf):
    k = F.col("vec_id")
    return _t(spark, sf, "embeddings").where(conditions.admitted(k * 37 % 160, (k * 13 % 50) / 50.0)).select("vec_id")


@_query("SELECT o_custkey AS group_id, count(*) AS size FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 23 = 0) GROUP BY 1")
def open_duplicates(spark, sf):
    members = _t(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("medium"))
    return conditions.open_groups(members, members.where("medium % 23 = 0"))


@_query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_name END, '') || CASE WHEN p_partkey % 3 > 0 THEN ' Stichwörter: ' || p_brand || ', ' || p_type || '.' ELSE '' END AS told FROM part")
def caption_texts(spark, sf):
    k = F.col("p_partkey")
    told = conditions.caption_text(F.when(k % 4 > 0, F.col("p_name")), F.when(k % 3 > 0, F.array(F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type"))))
    return _t(spark, sf, "part").select(k, told.alias("told"))


@_query("""WITH p AS (SELECT 'a' || user_id % 9 || CASE WHEN event_id % 2 = 0 THEN '/b' || user_id % 5 ELSE '' END AS folder, event_id FROM events)
SELECT folder || '/' || event_id AS path FROM p WHERE CASE WHEN folder[1:2] IN ('a1', 'a2', 'a3') THEN event_id % 3 > 0 ELSE folder[1:2] IN ('a4', 'a5') END""")
def observations_waiting(spark, sf):
    user, key = F.col("user_id"), F.col("event_id")
    folder = F.concat(F.lit("a"), (user % 9).cast("string"), F.when(key % 2 == 0, F.concat(F.lit("/b"), (user % 5).cast("string"))).otherwise(""))
    all_ = _t(spark, sf, "events").select(folder.alias("folder"), F.concat_ws("/", folder, key.cast("string")).alias("path"), key)
    read = all_.where(F.substring("folder", 1, 2).isin("a1", "a2", "a3")).select("folder", F.lit(True).alias("readable"))
    broken = all_.where(F.substring("folder", 1, 2).isin("a4", "a5")).select(F.substring("folder", 1, 2).alias("folder"), F.lit(False).alias("readable"))
    return conditions.still_waiting(all_.select("path"), read.union(broken).distinct(), all_.where("event_id % 3 > 0").select("path"))


@_query("SELECT event_id AS line, ts AS \"at\", 'a' || user_id % 3 || '/b' || user_id % 7 AS album FROM events WHERE user_id % 3 = 1 ORDER BY ts DESC, event_id DESC LIMIT 100")
def album_log(spark, sf):
    album = F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string"), F.lit("/b"), (F.col("user_id") % 7).cast("string"))
    return conditions.newest_lines(_t(spark, sf, "events").select(F.col("event_id").alias("line"), F.col("ts").alias("at"), album.alias("album")), 100, "a1")


@_query("SELECT event_id, ts, user_id FROM events WHERE (user_id % 3 = 2 AND user_id % 7 = 1) AND (ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 500)) ORDER BY ts, event_id LIMIT 40")
def album_page(spark, sf):
    """An album's media and those below it, the oldest first, beyond the last one seen."""
    path = F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string"), F.lit("/b"), (F.col("user_id") % 7).cast("string"))
    rows = _t(spark, sf, "events").withColumn("path", path).where(filters.Bundle(below="a2/b1").column("ts", "event_type", "path", "value"))
    return timeline.keyset_page(rows.select("event_id", "ts", "user_id"), "ts", "event_id", ("2024-01-10 00:00:00", 500), 40, backwards=True)


@_query("SELECT event_id, 'NATION_' || n AS name FROM (SELECT event_id, unnest(CASE WHEN event_id % 30 = event_id * 3 % 30 THEN [event_id % 30] ELSE [event_id % 30, event_id * 3 % 30] END) AS n FROM events) WHERE n < 25")
def mentions_found(spark, sf):
    k = F.col("event_id")
    text = F.concat(F.lit("Hi @nation_"), (k % 30).cast("string"), F.lit(", ask @NATION_"), (k * 3 % 30).cast("string"), F.lit("! mail@nation_1"))
    return filters.mentions(_t(spark, sf, "events").select("event_id", text.alias("text")), "event_id", "text", _t(spark, sf, "nation").select(F.col("n_name").alias("name")), "name")


_STAGES = ["metadata", "derive", "transcript", "analysis", "caption"]


@_query("""WITH r AS (SELECT event_id AS medium, unnest(['metadata', 'derive', 'transcript', 'analysis', 'caption']) AS stage FROM events WHERE event_type <> 'error'),
c AS (SELECT user_id * 3 AS medium, CASE WHEN user_id % 2 = 0 THEN 'transcript' ELSE 'analysis' END AS stage FROM events)
SELECT medium, stage FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.medium = r.medium AND ((c.stage = 'transcript' AND r.stage IN ('analysis', 'caption')) OR (c.stage = 'analysis' AND r.stage = 'caption')))""")
def results_invalidated(spark, sf):
    e = _t(spark, sf, "events")
    results = e.where("event_type <> 'error'").select(F.col("event_id").alias("medium"), F.explode(F.array(*map(F.lit, _STAGES))).alias("stage"))
    changed = e.select((F.col("user_id") * 3).alias("medium"), F.when(F.col("user_id") % 2 == 0, "transcript").otherwise("analysis").alias("stage"))
    return conditions.invalidated(results, changed, {"analysis": "transcript", "caption": "analysis"})


_LAT, _LON = "((s_suppkey * 7919 % 1200) / 10.0 - 60)", "((s_suppkey * 104729 % 3400) / 10.0 - 170)"


@_query(f"""WITH t AS (SELECT s_suppkey AS town, {_LAT} AS lat, {_LON} AS lon FROM supplier),
m AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN {_LAT.replace('s_suppkey', 'o_custkey')} + 0.05 END AS lat, {_LON.replace('s_suppkey', 'o_custkey')} AS lon, 'a' || o_custkey % 5 || '/b' || o_custkey % 3 AS path, o_orderkey % 4 AS version FROM orders),
d AS (SELECT key, town, 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(t.lat - m.lat) / 2), 2) + cos(radians(m.lat)) * cos(radians(t.lat)) * power(sin(radians(t.lon - m.lon) / 2), 2)))) AS km FROM m JOIN t ON abs(t.lat - m.lat) < 2 AND m.version < 3),
n AS (SELECT key, arg_min(town, (round(km, 6), town)) AS town FROM d WHERE round(km, 6) <= 50 GROUP BY 1)
SELECT m.key, CASE WHEN version >= 3 THEN -1 ELSE coalesce(n.town, CASE WHEN lat IS NULL THEN CASE WHEN path IN ('a1/b1', 'a2/b0') THEN 900 WHEN path[1:2] IN ('a1', 'a3') THEN 800 END END) END AS place, version < 3 AND lat IS NULL AND (path = 'a2/b0' OR path[1:2] IN ('a1', 'a3')) AS estimated FROM m LEFT JOIN n ON n.key = m.key""")
def media_placed_anew(spark, sf):
    at = lambda c, n, m, off: (F.col(c) * n % m) / 10.0 - off
    towns = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("town"), at("s_suppkey", 7919, 1200, 60).alias("lat"), at("s_suppkey", 104729, 3400, 170).alias("lon"))
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat(F.lit("a"), (cust % 5).cast("string"), F.lit("/b"), (cust % 3).cast("string"))
    media = _t(spark, sf, "orders").select(k.alias("key"), F.when(k % 3 > 0, at("o_custkey", 7919, 1200, 60) + 0.05).alias("lat"), at("o_custkey", 104729, 3400, 170).alias("lon"), path.alias("path"), F.lit(-1).cast("long").alias("place"), F.lit(False).alias("estimated"), (k % 4).alias("version"))
    folders = towns.select(F.explode(F.array(*(F.struct(F.lit(f).alias("folder"), F.lit(p).cast("long").alias("town")) for f, p in (("a1/b1", 900), ("a2/b0", 900), ("a1", 800), ("a3", 800))))).alias("o")).select("o.*").distinct()
    return places.placed_anew(media, towns, folders, 3, 50.0).select("key", "place", "estimated")
