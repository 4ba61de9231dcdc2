"""Registered queries of albums, comments, chapters, memories, report and stages, over the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import library
from lumenlake.operators.registry import QUERIES, _query, _t


def _albums(spark, sf):
    c = F.col("c_custkey")
    return _t(spark, sf, "customer").select(c.alias("album"), F.when(c > 1, F.floor(c / 4)).alias("parent"), F.col("c_name").alias("path"))


@_query("""WITH RECURSIVE t(c, p) AS (SELECT c_custkey, CASE WHEN c_custkey > 1 THEN c_custkey // 4 END FROM customer), up(node, ancestor, depth) AS (SELECT c, c, 0 FROM t UNION ALL SELECT node, t.p, depth + 1 FROM up JOIN t ON t.c = ancestor WHERE t.p IS NOT NULL AND depth < 50),
own AS (SELECT o_custkey AS album, count(*) AS media, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS cover FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1), b AS (SELECT p AS album, count(*) AS children FROM t WHERE p IS NOT NULL GROUP BY 1),
l AS (SELECT ancestor, depth, cover, row_number() OVER (PARTITION BY ancestor ORDER BY depth, c_name, node) AS place FROM up JOIN own ON node = album JOIN customer ON node = c_custkey),
g AS (SELECT ancestor AS album, CASE WHEN min(depth) = 0 THEN list(cover ORDER BY place)[1:1] ELSE list(cover ORDER BY place) END AS collage FROM l WHERE place <= 4 GROUP BY 1)
SELECT c AS album, coalesce(media, 0) AS media, coalesce(children, 0) AS children, coalesce(collage, []) AS collage FROM t LEFT JOIN own ON c = own.album LEFT JOIN b ON c = b.album LEFT JOIN g ON c = g.album""")
def album_tree(spark, sf):
    media = _t(spark, sf, "orders").where("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("medium"), F.col("o_custkey").alias("album"), F.col("o_orderdate").alias("at"))
    return library.album_tree(_albums(spark, sf), media)


@_query("""WITH p AS (SELECT 'A' || (c_custkey // 100) AS a, 'A' || (c_custkey // 100) || '/B' || (c_custkey // 10) AS b, 'A' || (c_custkey // 100) || '/B' || (c_custkey // 10) || '/C' || c_custkey AS c, c_custkey AS k FROM customer)
SELECT path FROM (SELECT a AS path FROM p UNION SELECT b FROM p UNION SELECT c FROM p) EXCEPT SELECT c FROM p WHERE k % 7 > 0""")
def album_ways(spark, sf):
    k = F.col("c_custkey")
    s = lambda n: F.floor(k / n).cast("string")
    p = _t(spark, sf, "customer").select(k, F.concat(F.lit("A"), s(100), F.lit("/B"), s(10), F.lit("/C"), s(1)).alias("path"))
    return library.ways(p, "path", p.where("c_custkey % 7 > 0"))


@_query("""WITH c AS (SELECT event_id AS comment, CASE WHEN event_id % 3 > 0 THEN event_id - 1 END AS parent, event_type = 'error' AS deleted FROM events), f AS (SELECT c.comment, coalesce(u.parent, c.parent) AS parent, c.deleted FROM c LEFT JOIN c u ON u.comment = c.parent)
SELECT comment, parent, deleted FROM f WHERE NOT deleted OR EXISTS (SELECT 1 FROM f g WHERE g.parent = f.comment AND NOT g.deleted)""")
def comment_threads(spark, sf):
    k = F.col("event_id")
    return library.threads(_t(spark, sf, "events").select(k.alias("comment"), F.when(k % 3 > 0, k - 1).alias("parent"), (F.col("event_type") == "error").alias("deleted")))


@_query("SELECT user_id, event_type, n, mine, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, l DESC, event_type) AS INT) AS place FROM (SELECT user_id, event_type, count(*) AS n, max(ts) AS l, bool_or(event_id % 5 = 3) AS mine FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)")
def reaction_histogram(spark, sf):
    return library.reactions(_t(spark, sf, "events").withColumn("who", F.col("event_id") % 5), "user_id", "event_type", "ts", "who", 3)


@_query("SELECT 'dear' AS trait, count(*) AS n FROM events WHERE value > 90 UNION ALL SELECT 'faults', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'late', count(*) FROM events WHERE hour(ts) >= 20")
def shelf_counts(spark, sf):
    return library.shelves(_t(spark, sf, "events"), {"dear": F.col("value") > 90, "faults": F.col("event_type") == "error", "late": F.hour("ts") >= 20, "none": F.col("value") > 1e9})


_PLACED = """r AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day, CASE WHEN day(ts) % 6 IN (1, 2) THEN event_type ELSE 'here' END AS place FROM events),
h AS (SELECT user_id, CASE WHEN max(places) >= 2 THEN first(place ORDER BY n DESC, place) END AS home FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS places FROM (SELECT user_id, place, count(*) AS n FROM r GROUP BY 1, 2)) GROUP BY 1)"""
_AWAY = f"""{_PLACED}, g AS (SELECT r.* FROM r JOIN h USING (user_id) WHERE home IS NOT NULL AND place <> home), d AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY day) AS i FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2 THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT user_id, day FROM g))),
e AS (SELECT user_id, day, min(day) OVER (PARTITION BY user_id, i) AS trip FROM d), x AS (SELECT g.*, trip FROM g JOIN e USING (user_id, day)),
t AS (SELECT user_id, trip, max(day) AS last_day, count(DISTINCT day) AS days, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(DISTINCT day) >= 2 AND count(*) >= 4)"""


def _away(spark, sf):
    e = _t(spark, sf, "events").withColumn("place", F.when((F.day("ts") % 6).isin(1, 2), F.col("event_type")).otherwise("here"))
    return library.away(e.select("event_id", "user_id", "ts", "place"), "user_id", "place", "ts", "event_id", least=4)


@_query(f"WITH {_PLACED} SELECT user_id, home FROM h")
def home_places(spark, sf):
    e = _t(spark, sf, "events").withColumn("place", F.when((F.day("ts") % 6).isin(1, 2), F.col("event_type")).otherwise("here"))
    return library.homes(e, "user_id", "place")


@_query(f"WITH {_AWAY} SELECT t.*, (SELECT first(place ORDER BY m DESC, place) FROM (SELECT place, count(*) AS m FROM x WHERE x.user_id = t.user_id AND x.trip = t.trip GROUP BY 1)) AS place FROM t")
def away_trips(spark, sf):
    return _away(spark, sf)[0].select("user_id", "trip", "last_day", "days", "n", "place")


@_query(f"WITH {_AWAY} SELECT r.user_id, trip, r.event_id FROM r JOIN e USING (user_id, day) JOIN t USING (user_id, trip)")
def trip_members(spark, sf):
    return _away(spark, sf)[1]


@_query("""WITH r AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderdate AS d, o_custkey % 10 AS album, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 2 ELSE 0 END AS score,
list_min(list_transform([-1, 0, 1], lambda s: abs(date_diff('day', make_date(CAST(year(o_orderdate) + s AS INT), 3, 14), CAST(o_orderdate AS DATE))))) AS off FROM orders WHERE year(o_orderdate) < 1998), f AS (SELECT *, (SELECT bool_or(off = 0) FROM r) AS exact FROM r WHERE off <= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY score DESC, md5(o_orderkey || '|1998-03-14'), o_orderkey) AS k FROM f WHERE NOT exact OR off = 0), m AS (SELECT * FROM b WHERE k <= 12), a AS (SELECT y, first(album ORDER BY n DESC, album) AS album FROM (SELECT y, album, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1)
SELECT m.y AS year, o_orderkey, CAST(row_number() OVER (PARTITION BY m.y ORDER BY d, o_orderkey) AS INT) AS place, NOT exact AS from_week, a.album FROM m JOIN a USING (y)""")
def memories_scored(spark, sf):
    o = _t(spark, sf, "orders").withColumn("album", F.col("o_custkey") % 10)
    score = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    return library.on_this_day(o, "o_orderkey", "o_orderdate", "album", score, 1998, 3, 14)


@_query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || 'may'), o_orderkey) AS r FROM orders)
SELECT o_orderstatus, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS INT) AS place FROM s WHERE r <= 40""")
def chapter_samples(spark, sf):
    return library.sampled_chapters(_t(spark, sf, "orders"), "o_orderstatus", "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")], "may", 40)


@_query("SELECT o_orderkey, year(o_orderdate) AS year, CAST(floor((row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) - 1) / 12) AS BIGINT) AS batch FROM orders")
def year_batches(spark, sf):
    return library.batches_by_year(_t(spark, sf, "orders"), F.year("o_orderdate"), [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "year", "batch")


@_query("""WITH p AS (SELECT 'kind' AS section, event_type AS key, value AS v FROM events UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), value FROM events UNION ALL SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), value FROM events UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), value FROM events
UNION ALL SELECT 'dear', CASE WHEN value > 90 THEN event_type END, 1 FROM events UNION ALL SELECT 'all', 'all', value FROM events), g AS (SELECT section, key, count(*) AS n, round(sum(v), 2) AS total FROM p WHERE key IS NOT NULL GROUP BY 1, 2)
SELECT section, key, n, total FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, key) AS r FROM g) WHERE section <> 'user' OR r <= 10""")
def library_report(spark, sf):
    v = F.col("value")
    sections = {"kind": (F.col("event_type"), v), "hour": (F.hour("ts"), v), "day": (F.to_date("ts"), v), "user": (F.col("user_id"), v), "dear": (F.when(v > 90, F.col("event_type")), F.lit(1)), "all": (F.lit("all"), v)}
    return library.report(_t(spark, sf, "events"), sections, {"user": 10})


@_query("SELECT event_id, ts FROM events WHERE NOT (event_id % 4 = 0 AND value > 20) AND NOT (event_id % 9 = 0) ORDER BY ts DESC, event_id LIMIT 200")
def stage_backlog(spark, sf):
    e = _t(spark, sf, "events")
    done = e.where("event_id % 4 < 2").select("event_id", F.when(F.col("event_id") % 4 == 0, "a").otherwise("b").alias("model"), F.when(F.col("value") > 20, 2).otherwise(1).alias("version"))
    return library.backlog(e, done, "event_id", "ts", "a", 2, 200, e.where("event_id % 9 = 0").select("event_id", F.lit(3).alias("attempts")))


@_query("""WITH s AS (SELECT event_id, CASE WHEN event_type IS DISTINCT FROM 'view' THEN 'not-for-this' WHEN event_id % 4 = 0 THEN CASE WHEN value > 50 THEN 'done' WHEN user_id % 5 >= 3 THEN 'given-up' ELSE 'open' END ELSE 'open' END AS a FROM events),
b AS (SELECT s.*, CASE WHEN event_id % 3 = 0 THEN 'done' WHEN a IN ('open', 'waiting', 'given-up') THEN 'waiting' ELSE 'open' END AS b FROM s)
SELECT event_id, 'transcript' AS stage, a AS state FROM b UNION ALL SELECT event_id, 'analysis', b FROM b""")
def stages_of_media(spark, sf):
    e = _t(spark, sf, "events")
    one = e.where("event_id % 4 = 0").select("event_id", (F.col("value") > 50).alias("ok"), (F.col("user_id") % 5).alias("attempts"))
    two = e.where("event_id % 3 = 0").select("event_id", F.lit(True).alias("ok"), F.lit(0).alias("attempts"))
    return library.stage_states(e, "event_id", [("transcript", F.col("event_type") == "view", one, None), ("analysis", F.lit(True), two, "transcript")])


@_query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def vector_upsert(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return library.upserted(c, c.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@_query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal ELSE 0.0 END AS c_acctbal FROM customer")
def write_once(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return library.written_once(c.where("c_custkey % 5 = 0"), c.withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@_query("SELECT c_custkey FROM (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 180 - 90 END, c_nationkey * 3 - 30) AS y, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 360 - 180 END, c_nationkey * 9 - 100) AS x FROM customer) WHERE y BETWEEN -20 AND 40 AND (x >= 150 OR x <= -60)")
def map_box(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    own = k % 4 > 0
    return _t(spark, sf, "customer").where(library.in_box(F.when(own, k % 180 - 90), F.when(own, k % 360 - 180), n * 3 - 30, n * 9 - 100, (-20, 150, 40, -60))).select(k)


@_query("SELECT p_partkey FROM part WHERE starts_with(lower(p_name), 'red') OR lower(p_brand) = 'red' ORDER BY p_retailprice DESC, p_partkey LIMIT 8")
def place_suggestion(spark, sf):
    return library.suggested(_t(spark, sf, "part").withColumn("keys", F.array(F.lower("p_brand"))), "p_partkey", "p_name", "keys", "p_retailprice", "Red", 8)


@_query("""WITH f AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-z]+')[1:6] AS tags FROM conversations), t AS (SELECT conv_id, turn, generate_subscripts(tags, 1) AS i, unnest(tags) AS tag FROM f),
g AS (SELECT conv_id, tag, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn * 100 + i), tag) AS r FROM t GROUP BY 1, 2), l AS (SELECT conv_id, role, min(turn) AS s FROM f WHERE role <> '' GROUP BY 1, 2)
SELECT conv_id, (SELECT list(tag ORDER BY r) FROM g WHERE g.conv_id = c.conv_id AND r <= 15) AS tags, (SELECT string_agg(role, chr(10) ORDER BY s, role) FROM l WHERE l.conv_id = c.conv_id) AS text, max(turn % 3) AS people,
(SELECT first(role ORDER BY n DESC, role) FROM (SELECT role, count(*) AS n FROM f WHERE f.conv_id = c.conv_id AND role IS NOT NULL GROUP BY 1)) AS scene FROM conversations c GROUP BY 1""")
def frames_combined(spark, sf):
    c = _t(spark, sf, "conversations")
    return library.combined(c.select("conv_id", "turn", "role", F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 6).alias("tags"), (F.col("turn") % 3).alias("people"), F.col("role").alias("scene")), "conv_id", "turn", "tags", "role", "people", "scene")


@_query("""SELECT conv_id, turn, CASE WHEN ends_with(s, '.') THEN s ELSE s || '.' END AS said FROM (SELECT conv_id, turn, trim(split_part(text, '. ', 1)) AS s FROM conversations)""")
def first_sentences(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", library.first_sentence(F.col("text")).alias("said"))


@_query("""SELECT event_id, CASE WHEN h < 6 THEN 'night' WHEN h < 11 THEN 'morning' WHEN h < 14 THEN 'noon' WHEN h < 18 THEN 'afternoon' WHEN h < 22 THEN 'evening' ELSE 'night' END AS part, CAST('0x' || substr(md5(event_id || 'book'), 1, 8) AS BIGINT) / 4294967296.0 AS chance FROM (SELECT *, hour(ts) AS h FROM events)""")
def parts_of_day(spark, sf):
    return _t(spark, sf, "events").select("event_id", library.part_of_day(F.col("ts")).alias("part"), library.chance(F.col("event_id"), "book").alias("chance"))


def book_thinned(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("book"), "p_partkey", F.xxhash64("p_name").alias("print"), F.col("p_retailprice").alias("score"))
    return library.thinned(p, "book", "p_partkey", "print", "score", 24)


# A greedy choice has no SQL: tests/test_library.py holds it against plain Python.
QUERIES["book_thinned"] = book_thinned
