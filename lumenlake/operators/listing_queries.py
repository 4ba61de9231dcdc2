"""Registered queries over pages of faces and notifications, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import files, listings
from lumenlake.operators.identity_queries import _FACES, _faces
from lumenlake.operators.registry import _query, _t

_SHOWN = "s AS (SELECT medium, TIMESTAMP '2020-01-01' + to_days(CAST(medium * 37 % 1500 AS INT)) AS \"at\" FROM f WHERE medium % 7 > 0 GROUP BY 1)"


def _shown(f):
    at = F.expr("TIMESTAMP '2020-01-01' + make_dt_interval(CAST(medium * 37 % 1500 AS INT))")
    return f.where("medium % 7 > 0").select("medium", at.alias("at")).distinct()


@_query(f"""WITH {_FACES}, {_SHOWN}, g AS (SELECT face, face % 23 AS cluster, pixels * score AS c FROM f WHERE person IS NULL AND medium IN (SELECT medium FROM s)),
z AS (SELECT cluster, count(*) AS size FROM g GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT *, CAST(row_number() OVER (ORDER BY size DESC, cluster) AS INT) AS place FROM z),
l AS (SELECT cluster, face, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, face) AS r FROM g)
SELECT cluster, size, array_to_string(list(face ORDER BY r) FILTER (WHERE r <= 6), ',') AS faces, place, (SELECT count(*) FROM z) > 8 AS more FROM p JOIN l USING (cluster) WHERE place BETWEEN 4 AND 8 GROUP BY ALL""")
def face_groups(spark, sf):
    f = _faces(spark, sf)
    page = listings.groups(f.withColumn("cluster", F.when(F.col("person").isNull(), F.col("face") % 23)), _shown(f), 3, 5)
    return page.withColumn("faces", F.array_join(F.transform("faces", lambda x: x.cast("string")), ","))


@_query(f"""WITH {_FACES}, {_SHOWN}, q AS (SELECT face, suggested AS person, n_name AS name, distance, CAST(row_number() OVER (ORDER BY distance, face % 31 DESC, face) AS INT) AS place FROM f JOIN nation ON n_nationkey = suggested WHERE person IS NULL AND medium IN (SELECT medium FROM s) AND n_nationkey <> 3)
SELECT face, person, name, distance, place, (SELECT count(*) FROM q) > 15 AS more FROM q WHERE place BETWEEN 6 AND 15""")
def face_questions(spark, sf):
    f = _faces(spark, sf)
    people = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("person"), F.col("n_name").alias("name"), (F.col("n_nationkey") == 3).alias("hidden"))
    return listings.questions(f.withColumn("created", F.col("face") % 31), people, _shown(f), 5, 10)


@_query(f"""WITH {_FACES}, {_SHOWN}, o AS (SELECT face, medium, "at", year("at") AS y FROM f JOIN s USING (medium) WHERE person = 4 AND assigned_by = 'auto'),
t AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(face AS VARCHAR)), face) AS turn FROM o), p AS (SELECT face, medium, "at", CAST(row_number() OVER (ORDER BY turn, y, face) AS INT) AS place FROM t)
SELECT *, (SELECT count(*) FROM p) > 12 AS more FROM p WHERE place <= 12""")
def faces_to_check(spark, sf):
    f = _faces(spark, sf)
    return listings.faces_of(f.withColumn("second", F.lit(None).cast("int")), _shown(f), 4, 0, 12, "auto")


@_query(f"""WITH {_FACES}, {_SHOWN} SELECT medium, "at" FROM s WHERE medium IN (SELECT medium FROM f WHERE person = 4) AND ("at" < TIMESTAMP '2023-01-01' OR ("at" = TIMESTAMP '2023-01-01' AND medium < 60)) ORDER BY "at" DESC, medium DESC LIMIT 20""")
def media_of_person(spark, sf):
    f = _faces(spark, sf)
    return listings.media_of(f, _shown(f), 4, ("2023-01-01", 60), 20)


@_query("""WITH n AS (SELECT event_id AS note, event_type AS kind, ts AS updated, event_id % 5 AS n, event_id % 4 = 0 AS unread, CASE WHEN event_id % 3 > 0 THEN event_id % 100 END AS medium, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS own, event_id % 50 AS comment FROM events WHERE user_id = 7 AND ts < TIMESTAMP '2024-01-25'),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY updated DESC, note) AS INT) AS place FROM n), m AS (SELECT p.*, coalesce(own, CASE WHEN medium IS NOT NULL THEN medium % 11 END) AS album FROM p WHERE place <= 30)
SELECT note, kind, updated, n, unread, 'NATION_' || (note % 9 + 1) || ',NATION_' || note % 9 AS actors, medium, album, r_name AS path, CASE WHEN comment % 3 > 0 THEN 'said ' || comment END AS excerpt, place, (SELECT count(*) FROM n) > 30 AS more
FROM m LEFT JOIN region ON r_regionkey = album""")
def notification_list(spark, sf):
    e, k, none = _t(spark, sf, "events"), F.col("event_id"), F.lit(None)
    notes = e.select(k.alias("note"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.when(k % 3 > 0, k % 100).alias("medium"), F.when(k % 3 == 0, k % 7).alias("album"), (k % 50).alias("comment"), F.array(k % 9, F.lit(99), k % 9 + 1).alias("actors"), (k % 5).alias("n"), F.col("ts").alias("updated"), F.when(k % 4 > 0, F.col("ts")).otherwise(none.cast("timestamp")).alias("read_at"))
    people = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("person"), F.col("n_name").alias("name"))
    media, comments = e.where("event_id < 100").select(k.alias("medium"), (k % 11).alias("album")), e.where("event_id < 50").select(k.alias("comment"), F.concat(F.lit("said "), k.cast("string")).alias("body"), (k % 3 == 0).alias("deleted"))
    albums = _t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("album"), F.col("r_name").alias("path"))
    return listings.notifications(notes, 7, people, media, albums, comments, "2024-01-25").withColumn("actors", F.array_join("actors", ","))


@_query("""SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderdate + to_seconds(36930) WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate WHEN 3 THEN date_trunc('month', o_orderdate) ELSE TIMESTAMP '2024-02-03' END AS TIMESTAMP) AS taken,
['exif', 'gps', 'filename', 'folder_name', 'file_mtime'][CAST(o_orderkey % 5 + 1 AS INT)] AS source FROM orders""")
def capture_dates(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = lambda i, f: F.when(k % 5 == i, F.date_format(d, f))
    name = F.coalesce(F.concat(F.lit("IMG_"), text(2, "yyyyMMdd"), F.lit(".jpg")), F.lit("IMG.jpg"))
    path = F.concat(F.lit("Bilder/"), F.coalesce(F.concat(text(3, "yyyy-MM"), F.lit(" Reise/Tag ")), F.lit("alt/")), name)
    told = files.captured([text(0, "yyyy:MM:dd '10:15:30'"), F.lit(None).cast("string")], text(1, "yyyy:MM:dd HH:mm:ss"), name, path, F.lit("2024-02-03"))
    return _t(spark, sf, "orders").select(k, told.alias("t")).select("o_orderkey", F.col("t.at").alias("taken"), "t.source")
