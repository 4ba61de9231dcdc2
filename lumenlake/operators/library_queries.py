"""More registered queries: picks and filters over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import filters, picks, search
from lumenlake.operators.registry import _query, _t


@_query("SELECT o_orderkey, month, place FROM (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_totalprice DESC, o_orderkey DESC) AS INT) AS place FROM orders) WHERE place <= 4")
def covers(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
    return picks.first_of(o, ["month"], [F.desc("o_totalprice"), F.desc("o_orderkey")], 4).select("o_orderkey", "month", "place")


@_query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def newest_cover(spark, sf):
    return picks.first_of(_t(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts")


@_query("SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, length(p_name), p_partkey) AS INT) AS place FROM part) WHERE place <= 3")
def best_first(spark, sf):
    return picks.first_of(_t(spark, sf, "part"), ["p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.length("p_name"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "place")


@_query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, ts NULLS LAST, event_id) AS r FROM events) WHERE r = 1")
def best_moment(spark, sf):
    return picks.first_of(_t(spark, sf, "events"), ["user_id"], [F.desc_nulls_last("value"), F.asc_nulls_last("ts"), F.col("event_id")]).select("user_id", "event_id")


@_query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def home_mode(spark, sf):
    return picks.most_common(_t(spark, sf, "events"), "user_id", "event_type")


@_query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events)
WHERE m <= 8 OR i = 0 OR floor(i * 8.0 / m) <> floor((i - 1) * 8.0 / m)""")
def even_stretches(spark, sf):
    return picks.even_stretches(_t(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")], 8).select("user_id", "event_id")


@_query('SELECT user_id, event_id, lag(event_id) OVER w AS "before", lead(event_id) OVER w AS "after" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)')
def neighbour_context(spark, sf):
    return picks.neighbours(_t(spark, sf, "events"), "user_id", "ts", "event_id")


@_query("""WITH t AS (SELECT c_mktsegment AS g, n_name AS term FROM customer JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT g, term, count(*) AS n FROM t GROUP BY 1, 2),
w AS (SELECT g, count(*) AS whole FROM t GROUP BY 1), d AS (SELECT term, count(*) AS df FROM n GROUP BY 1),
s AS (SELECT g AS c_mktsegment, term AS n_name, n, round(n / whole * ln((SELECT count(*) FROM w) / df), 6) AS score FROM n JOIN w USING (g) JOIN d USING (term) WHERE n >= 3 AND n / whole >= 0.02)
SELECT c_mktsegment, n_name, n, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY score DESC, n_name) AS INT) AS place FROM s) WHERE place <= 3""")
def distinctive_terms(spark, sf):
    c = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return picks.distinctive(c, "c_mktsegment", "n_name", 0.02, 3, 3)


@_query("""WITH t AS (SELECT l_orderkey, list_distinct(list(l_suppkey % 20)) AS tags FROM lineitem GROUP BY 1)
SELECT a.l_orderkey, round(len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))), 6) AS likeness FROM t a JOIN t b ON b.l_orderkey = a.l_orderkey + 1""")
def tag_likeness(spark, sf):
    t = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 20).alias("tags"))
    other = t.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("tags").alias("next"))
    return t.join(other, "l_orderkey").select("l_orderkey", F.round(picks.likeness(F.col("tags"), F.col("next")), 6).alias("likeness"))


@_query("SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS members, max(n) AS largest FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def cluster_sizes(spark, sf):
    return picks.group_sizes(_t(spark, sf, "orders"), "o_custkey")


@_query("""WITH m AS (SELECT label, pos, round(avg(x), 6) AS middle FROM (SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2),
p AS (SELECT label, list(middle ORDER BY pos) AS middle FROM m GROUP BY 1),
d AS (SELECT vec_id, p.label, round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), middle) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(middle, middle))), 6) AS distance FROM embeddings, p)
SELECT vec_id, label, distance, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) AS INT) AS place FROM d WHERE distance <= 0.95) WHERE place <= 5""")
def prototype_neighbours(spark, sf):
    e = _t(spark, sf, "embeddings")
    middles = search.middles(e, "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "middle"))), lambda x: x["middle"]).alias("middle"))
    return picks.prototype_neighbours(e.select("vec_id", "embedding"), "vec_id", "embedding", middles, "label", "middle", 0.95, 5)


@_query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('click', 'view') AND value BETWEEN 1 AND 50")
def filter_bundle(spark, sf):
    b = filters.Bundle(since="2024-01-05", until="2024-01-20", kinds=["click", "view"], within=(1.0, 50.0))
    return _t(spark, sf, "events").where(b.column("ts", "event_type", "event_type", "value")).select("event_id")


@_query("SELECT event_id, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 420 AS quiet FROM events")
def quiet_hours(spark, sf):
    return _t(spark, sf, "events").select("event_id", filters.quiet(F.col("ts"), 22 * 60, 7 * 60).alias("quiet"))


@_query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def retention(spark, sf):
    return filters.kept_for(_t(spark, sf, "events").select("event_id", "ts"), "ts", 14, "event_id")


@_query("SELECT user_id, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS start_at, count(*) AS n, count(*) > 2 AS \"over\" FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def fixed_windows(spark, sf):
    return filters.fixed_windows(_t(spark, sf, "events"), "user_id", "ts", 3600, 2)


_TREE = "SELECT c_custkey AS c, CASE WHEN c_custkey > 1 THEN c_custkey // 4 END AS p FROM customer"


@_query(f"""WITH RECURSIVE t AS ({_TREE}), up(node, ancestor, depth) AS (SELECT c, c, 0 FROM t UNION ALL SELECT node, t.p, depth + 1 FROM up JOIN t ON t.c = ancestor WHERE t.p IS NOT NULL AND depth < 50)
SELECT ancestor, count(*) AS below, CAST(max(depth) AS INT) AS deepest FROM up GROUP BY 1""")
def tree_closure(spark, sf):
    edges = _t(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 4)).alias("p"))
    return filters.closure(edges, "c", "p").groupBy("ancestor").agg(F.count(F.lit(1)).alias("below"), F.max("depth").alias("deepest"))


@_query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER w AS l, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR l IS DISTINCT FROM event_type")
def unlike_repeats(spark, sf):
    return filters.unlike_repeats(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", "event_id")


@_query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS n FROM events GROUP BY 1")
def names_of_each(spark, sf):
    return _t(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.count_distinct(F.to_date("ts")).alias("days"), F.count(F.lit(1)).alias("n"))


@_query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE value > 90")
def followers(spark, sf):
    e = _t(spark, sf, "events")
    return e.where("event_type = 'click'").select("user_id").union(e.where("value > 90").select("user_id")).distinct()


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 21 OFFSET 40")
def offset_page(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(21)


@_query("SELECT o_custkey, sum(o_totalprice) AS total, arg_max(o_orderkey, o_totalprice) AS cover FROM orders GROUP BY 1 HAVING count(*) >= 2")
def heaviest_groups(spark, sf):
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.max_by("o_orderkey", "o_totalprice").alias("cover"), F.count(F.lit(1)).alias("_n"))
    return o.where("_n >= 2").drop("_n")


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_numbers(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k >= 50")
