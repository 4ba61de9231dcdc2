"""Registered queries of the library's operators over the driver's tables, each beside the SQL that tells the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import changes, chapters, groups, places, search, timeline
from lumenlake.operators.registry import _Q, ORACLES, QUERIES, VECTOR, _query, _t  # noqa: F401
from lumenlake.streaming import arrivals


@_query("SELECT event_id, ts, user_id FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 500) ORDER BY ts DESC, event_id DESC LIMIT 60")
def keyset_page(spark, sf):
    return timeline.keyset_page(_t(spark, sf, "events").select("event_id", "ts", "user_id"), "ts", "event_id", ("2024-01-20 00:00:00", 500), 60)


@_query("SELECT event_id, ts, user_id FROM events WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 500) ORDER BY ts, event_id LIMIT 60")
def keyset_back(spark, sf):
    return timeline.keyset_page(_t(spark, sf, "events").select("event_id", "ts", "user_id"), "ts", "event_id", ("2024-01-10 00:00:00", 500), 60, backwards=True)


@_query("SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS mark, count(*) AS n, min(o_orderdate) AS first_at FROM orders GROUP BY 1")
def marks_year(spark, sf):
    return timeline.marks(_t(spark, sf, "orders"), "o_orderdate", "year")


@_query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mark, count(*) AS n, min(o_orderdate) AS first_at FROM orders GROUP BY 1")
def marks_month(spark, sf):
    return timeline.marks(_t(spark, sf, "orders"), "o_orderdate", "month")


@_query("SELECT CAST(date_trunc('day', ts) AS DATE) AS mark, count(*) AS n, min(ts) AS first_at FROM events GROUP BY 1")
def marks_day(spark, sf):
    return timeline.marks(_t(spark, sf, "events"), "ts", "day")


@_query("""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 172800000000 THEN 1 ELSE 0 END AS cut FROM events),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n FROM i GROUP BY user_id, island""")
def trips_islands(spark, sf):
    return timeline.sessions(_t(spark, sf, "events"), "user_id", "ts", 2 * 86_400)


@_query("SELECT x.event_id AS a, y.event_id AS b FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id < y.event_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 600000000")
def burst_pairs(spark, sf):
    return timeline.burst_pairs(_t(spark, sf, "events"), "user_id", "event_id", "ts", 600)


@_query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events")
def hourly_arrivals(spark, sf):
    return timeline.arrivals(_t(spark, sf, "events"), "ts", "user_id", 3600).select("event_id", "n")


@_query(f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20")
def knn(spark, sf):
    return search.nearest(_t(spark, sf, "embeddings"), "vec_id", "embedding", VECTOR, 20)


@_query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(t, lambda x: x = 'the')) + len(list_filter(t, lambda x: x = 'and')) AS BIGINT) AS hits FROM t WHERE list_contains(t, 'the') AND list_contains(t, 'and')""")
def words_and(spark, sf):
    return search.words_and(_t(spark, sf, "documents"), "doc_id", "text", ["the", "and"])


@_query("""
WITH w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part),
g AS (SELECT DISTINCT p_partkey, substr('  ' || w || ' ', CAST(i AS INT), 3) AS g FROM w, unnest(range(1, len(w) + 2)) AS r(i)),
q AS (SELECT DISTINCT substr('  ' || w || ' ', CAST(i AS INT), 3) AS g FROM (SELECT unnest(['gren', 'stel']) AS w), unnest(range(1, len(w) + 2)) AS r(i)),
n AS (SELECT p_partkey, count(*) AS n, count(q.g) AS shared FROM g LEFT JOIN q USING (g) GROUP BY p_partkey)
SELECT p_partkey, round(shared / (n + (SELECT count(*) FROM q) - shared), 6) AS similarity FROM n WHERE round(shared / (n + (SELECT count(*) FROM q) - shared), 6) >= 0.2""")
def names_trigram(spark, sf):
    return search.similar_names(_t(spark, sf, "part"), "p_partkey", "p_name", "gren stel", 0.2)


@_query(f"""
WITH v AS (SELECT vec_id AS id, round(list_cosine_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS d FROM embeddings),
t AS (SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x = 'the')) AS n FROM documents),
a AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM v ORDER BY d, id LIMIT 200),
b AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM t WHERE n > 0 ORDER BY n DESC, id LIMIT 200)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def rrf_search(spark, sf):
    near = search.nearest(_t(spark, sf, "embeddings"), "vec_id", "embedding", VECTOR, 200).withColumnRenamed("vec_id", "id")
    said = search.words_and(_t(spark, sf, "documents"), "doc_id", "text", ["the"]).withColumnRenamed("doc_id", "id")
    return search.fuse([search.ranked(near, "id", F.asc("distance"), 200), search.ranked(said, "id", F.desc("hits"), 200)], "id")


@_query("""
WITH j AS (SELECT n_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT 'n_name' AS facet, n_name AS value FROM j UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM j UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM j),
c AS (SELECT facet, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT facet, value, n FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 10""")
def facets(spark, sf):
    j = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return search.facets(j, ["n_name", "c_mktsegment", "o_orderpriority"], 10)


@_query("SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2, 5) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 3")
def all_of_filter(spark, sf):
    return search.all_of(_t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", [1, 2, 5])


@_query("SELECT min(doc_id) AS group_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_groups(spark, sf):
    return search.equal_groups(_t(spark, sf, "documents"), "doc_id", F.col("text"))


@_query("""
WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM x a JOIN x b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2""")
def pairs(spark, sf):
    return search.together(_t(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 2)


@_query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def missing_backlog(spark, sf):
    return _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left_anti")


_PRINTS = """
w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) AS h FROM w),
b AS (SELECT doc_id, i, 2 * sum((h >> i) & 1) > count(*) AS bit FROM h, range(60) AS r(i) GROUP BY 1, 2),
fp AS (SELECT doc_id, CAST(sum(CASE WHEN bit THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS p FROM b GROUP BY 1)"""
_TIES = f"""{_PRINTS},
one AS (SELECT p, min(doc_id) AS k FROM fp GROUP BY 1),
ties AS (SELECT o.k AS a, fp.doc_id AS b FROM fp JOIN one o USING (p) WHERE fp.doc_id > o.k
  UNION SELECT x.k AS a, y.k AS b FROM one x JOIN one y ON x.k < y.k AND bit_count(xor(x.p, y.p)) <= 4)"""


def _prints(spark, sf):
    return groups.written(groups.fingerprints(_t(spark, sf, "documents"), "doc_id", "text"))


@_query(f"WITH {_PRINTS}, one AS (SELECT p, min(doc_id) AS k FROM fp GROUP BY 1) SELECT x.k AS a, y.k AS b FROM one x JOIN one y ON x.k < y.k AND bit_count(xor(x.p, y.p)) <= 4")
def near_blocking(spark, sf):
    return groups.near_ties(_prints(spark, sf), "doc_id", "p")


@_query(f"WITH RECURSIVE {_TIES}, e AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties), r AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node) SELECT node, min(label) AS group_id FROM r GROUP BY 1")
def components(spark, sf):
    prints = _prints(spark, sf)
    return groups.components(groups.exact_ties(prints, "doc_id", "p").union(groups.near_ties(prints, "doc_id", "p")))


@_query(f"""WITH RECURSIVE {_TIES}, e AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
r AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node), g AS (SELECT node, min(label) AS group_id FROM r GROUP BY 1)
SELECT group_id, count(*) AS n, CAST(CASE WHEN count(DISTINCT p) = 1 THEN 0 ELSE 1 END AS INT) AS kind FROM g JOIN fp ON doc_id = node GROUP BY 1""")
def group_kinds(spark, sf):
    prints = _prints(spark, sf)
    ties = groups.exact_ties(prints, "doc_id", "p").withColumn("kind", F.lit(0)).union(groups.near_ties(prints, "doc_id", "p").withColumn("kind", F.lit(1)))
    return groups.kinds(ties, 1).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))


_ISLANDS = """
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 86400000000 THEN 1 ELSE 0 END AS cut FROM events),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g),
trips AS (SELECT user_id, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n FROM i GROUP BY user_id, island HAVING count(*) >= 15 AND max(ts)::DATE - min(ts)::DATE >= 1)"""


def _trips(spark, sf):
    return chapters.trips(_t(spark, sf, "events"), "user_id", "ts", 86_400, 15, 2)


@_query(f"WITH {_ISLANDS} SELECT * FROM trips")
def trips(spark, sf):
    return _trips(spark, sf)


@_query(f"""WITH {_ISLANDS} SELECT user_id, ts::DATE AS day, count(*) AS n FROM events
WHERE NOT EXISTS (SELECT 1 FROM trips t WHERE t.user_id = events.user_id AND events.ts::DATE BETWEEN t.start_at::DATE AND t.end_at::DATE) GROUP BY 1, 2 HAVING count(*) >= 4""")
def day_chapters(spark, sf):
    return chapters.full_days(_t(spark, sf, "events"), "user_id", "ts", 4, _trips(spark, sf))


_PLACED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _placed(spark, sf):
    return _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


@_query(f"SELECT n_name, count(*) AS n, count(DISTINCT o_orderdate::DATE) AS days, CAST(year(min(o_orderdate)) AS INT) AS first_year, CAST(year(max(o_orderdate)) AS INT) AS last_year FROM {_PLACED} GROUP BY 1 HAVING count(*) >= 40 AND count(DISTINCT o_orderdate::DATE) >= 3")
def place_chapters(spark, sf):
    return chapters.place_chapters(_placed(spark, sf), "n_name", "o_orderdate", 40, 3)


@_query("""
WITH r AS (SELECT CASE WHEN month(o_orderdate) = 12 AND day(o_orderdate) = 31 THEN 'new year' WHEN month(o_orderdate) = 12 AND day(o_orderdate) BETWEEN 24 AND 26 THEN 'christmas' END AS ritual, year(o_orderdate) AS y FROM orders)
SELECT ritual, count(*) AS n, count(DISTINCT y) AS years FROM r WHERE ritual IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT y) >= 2""")
def rituals(spark, sf):
    return chapters.rituals(_t(spark, sf, "orders"), "o_orderdate", {"christmas": [(12, 24), (12, 25), (12, 26)], "new year": [(12, 31)]}, 2, 2)


@_query("""
WITH e AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 30),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, year) <= 3),
t AS (SELECT l_suppkey FROM f GROUP BY 1 ORDER BY max(n) DESC, l_suppkey LIMIT 10)
SELECT l_suppkey, year, n FROM f JOIN t USING (l_suppkey)""")
def person_year(spark, sf):
    return chapters.person_years(_t(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", 30, 10, 3)


_LISTS = {"articles": ["the", "der", "le", "el"], "links": ["and", "und", "et", "y"], "water": ["sea", "meer", "mer", "mar"]}


@_query(" UNION ALL ".join(f"SELECT '{t}' AS theme, count(*) AS n FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), {w}) HAVING count(*) >= 20" for t, w in _LISTS.items()))
def themes(spark, sf):
    return chapters.themes(_t(spark, sf, "documents"), "doc_id", "text", _LISTS, 20)


@_query("SELECT turn, source, doc_id FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS turn FROM documents) WHERE turn <= 3")
def round_robin(spark, sf):
    return chapters.dealt(_t(spark, sf, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("turn", "source", "doc_id")


@_query("SELECT o_orderkey, CAST(turn AS INT) AS turn FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS turn FROM orders) WHERE turn <= 20")
def deal_by_year(spark, sf):
    return chapters.dealt(_t(spark, sf, "orders"), [F.year("o_orderdate")], [F.md5(F.col("o_orderkey").cast("string").cast("binary"))], 20).select("o_orderkey", "turn")


@_query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) = 1")
def collapse_faces(spark, sf):
    return chapters.dealt(_t(spark, sf, "events"), ["user_id", "event_type"], [F.desc_nulls_last("value"), F.col("event_id")], 1).select("user_id", "event_type", "event_id")


@_query("SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderkey, CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders WHERE month(o_orderdate) = 3 AND day(o_orderdate) = 14 AND year(o_orderdate) < 2001 QUALIFY rank <= 12")
def memories(spark, sf):
    return chapters.memories(_t(spark, sf, "orders"), "o_orderkey", "o_orderdate", "o_totalprice", 3, 14, 2001, 12)


# The tables have no coordinates: keys stand for points spread over the map.
_LAT, _LON = "(({k} * 37) % 1300) / 10.0 - 65", "(({k} * 91) % 3600) / 10.0 - 180"


def _points(df, key):
    return df.select(key, F.expr(f"cast({_LAT.format(k=key)} as double)").alias("lat"), F.expr(f"cast({_LON.format(k=key)} as double)").alias("lon"))


def _sql_points(table, key):
    return f"SELECT {key}, CAST({_LAT.format(k=key)} AS DOUBLE) AS lat, CAST({_LON.format(k=key)} AS DOUBLE) AS lon FROM {table}"


@_query(f"""
WITH p AS ({_sql_points("customer", "c_custkey")})
SELECT CAST(floor((lon + 180) / 360 * (256 * 16 / 60)) AS BIGINT) AS cell_x, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * (256 * 16 / 60)) AS BIGINT) AS cell_y,
  count(*) AS n, round(avg(lat), 6) AS latitude, round(avg(lon), 6) AS longitude, max(c_custkey) AS newest FROM p GROUP BY 1, 2""")
def map_clusters(spark, sf):
    return places.map_clusters(_points(_t(spark, sf, "customer"), "c_custkey"), "c_custkey", "lat", "lon", 4)


@_query(f"""
WITH p AS ({_sql_points("customer", "c_custkey")}), t AS ({_sql_points("supplier", "s_suppkey")}),
d AS (SELECT c_custkey, s_suppkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2)))), 6) AS km FROM p, t)
SELECT c_custkey, s_suppkey, km FROM d WHERE km <= 100 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) = 1""")
def geocode(spark, sf):
    return places.nearest_town(_points(_t(spark, sf, "customer"), "c_custkey"), "c_custkey", _points(_t(spark, sf, "supplier"), "s_suppkey"), "s_suppkey", 100)


def _paths(spark, sf):
    at = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return at.select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path"))


_PATHS = "p AS (SELECT c_custkey, r_name AS a, r_name || '/' || n_name AS b, r_name || '/' || n_name || '/' || c_mktsegment AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@_query(f"WITH {_PATHS} SELECT folder, count(*) AS n FROM (SELECT unnest([a, b, c]) AS folder FROM p) GROUP BY 1")
def subtree_counts(spark, sf):
    return places.subtree_counts(_paths(spark, sf), "path")


@_query(f"WITH {_PATHS} SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN 'nation ' || n_nationkey ELSE 'region ' || n_regionkey END AS place FROM p JOIN nation ON b LIKE '%/' || n_name")
def longest_prefix_place(spark, sf):
    nation, region = _t(spark, sf, "nation"), _t(spark, sf, "region")
    some = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 2 = 0").select(F.concat_ws("/", "r_name", "n_name").alias("folder"), F.concat(F.lit("nation "), "n_nationkey").alias("place"))
    return places.longest_prefix(_paths(spark, sf), "c_custkey", "path", some.union(region.select("r_name", F.concat(F.lit("region "), "r_regionkey"))), "folder", "place")


@_query("""
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_orderkey)
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def change_detect(spark, sf):
    # Two looks at one library: the later one lost some rows, has some new ones and one field emptied in others.
    orders = _t(spark, sf, "orders")
    after = orders.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    return changes.compared(orders.where("o_orderkey % 7 <> 0"), after, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@_query("""
WITH m AS (SELECT user_id, ts, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS moved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, max(ts) AS stable_since FROM m WHERE moved GROUP BY 1""")
def stability(spark, sf):
    return changes.settled(_t(spark, sf, "events"), "user_id", "ts", "event_type")


@_query("SELECT * FROM (SELECT 'event' AS kind, event_id AS id, ts AS \"at\" FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders) ORDER BY \"at\" DESC, kind, id LIMIT 60")
def news_feed(spark, sf):
    events, orders = _t(spark, sf, "events"), _t(spark, sf, "orders")
    return changes.feed([("event", events.select(F.col("event_id").alias("id"), F.col("ts").alias("at"))), ("order", orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")))], 60)


@_query("""
WITH r AS (SELECT l_orderkey AS event, l_suppkey AS person, l_partkey AS actor, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS p FROM lineitem)
SELECT event, person, CASE min(p) WHEN 0 THEN 'reply' WHEN 1 THEN 'mention' ELSE 'follow' END AS reason FROM r WHERE person <> actor GROUP BY 1, 2""")
def notify_targets(spark, sf):
    each = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("actor"), "l_returnflag", "l_linestatus")
    return changes.notified([("reply", each.where("l_returnflag = 'R'")), ("mention", each.where("l_linestatus = 'F'")), ("follow", each)], "actor")


@_query("""
WITH b AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)) > 21600000000 THEN 1 ELSE 0 END AS cut FROM events),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS bundle FROM b)
SELECT user_id || '/' || event_type AS topic, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n FROM i GROUP BY user_id, event_type, bundle""")
def bundling(spark, sf):
    return timeline.sessions(_t(spark, sf, "events").withColumn("topic", F.concat_ws("/", "user_id", "event_type")), "topic", "ts", 6 * 3600)


@_query("SELECT conv_id, count(*) AS n, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(*) FILTER (WHERE turn > 0) AS answers FROM conversations GROUP BY 1")
def comment_tree(spark, sf):
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.count_if(F.col("turn") > 0).alias("answers"))


@_query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) AS persons, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY 1")
def report_years(spark, sf):
    return _t(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_distinct("o_custkey").alias("persons"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))


@_query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE value IS NULL) AS without_value, min(ts) AS first_at, max(ts) AS last_at FROM events")
def report_totals(spark, sf):
    return _t(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"), F.count_if(F.col("value").isNull()).alias("without_value"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@_query("SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 30")
def tags_top(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    return _t(spark, sf, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(30)


@_query("SELECT label, CAST(pos AS INT) AS pos, round(avg(x), 6) AS middle FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY 1, 2")
def centroids(spark, sf):
    return search.middles(_t(spark, sf, "embeddings"), "label", "embedding")


@_query("SELECT b.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) AND b.vec_id <> a.vec_id ORDER BY distance, b.vec_id LIMIT 24")
def similar(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    own = vectors.orderBy("vec_id").first()  # one row: the vector asked about
    return search.nearest(vectors.where(F.col("vec_id") != own["vec_id"]), "vec_id", "embedding", own["embedding"], 24)


@_query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_once(spark, sf):
    return arrivals.taken_in(spark, sf, "events.parquet", "event_id", "ts", "1 day").select("event_id", "user_id", "event_type")


from lumenlake.operators import album_queries, book_queries, change_queries, condition_queries, file_queries, finder_queries, fulltext_queries, identity_queries, index_queries, library_queries, listing_queries, print_queries, story_queries, stream_queries, vector_queries  # noqa: E402, F401  (they register their queries here)
