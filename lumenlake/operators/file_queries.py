"""Registered queries over files. The driver's tables hold no files: a fixed rule makes a listing from all of part."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import files
from lumenlake.operators.registry import _query, _t

_FILES = """f AS (SELECT 'F' || (p_partkey // 30) AS folder, CASE WHEN p_size % 11 = 0 THEN '.' ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN 'IMG_' ELSE 'Pic' END || (p_partkey // 3) || '.' ||
CASE p_partkey % 3 WHEN 0 THEN ['JPG', 'heic', 'png', 'txt'][p_size % 4 + 1] WHEN 1 THEN ['cr2', 'MOV', 'mp4', 'nef'][p_size % 4 + 1] ELSE ['jpeg', 'mts', 'dng', 'tiff'][p_size % 4 + 1] END AS name, p_size AS size, CAST(floor(p_retailprice) AS BIGINT) AS mtime, p_partkey AS id, p_name FROM part)"""
_KIND = "CASE WHEN e IN ('jpg', 'jpeg', 'heic', 'heif', 'png', 'webp', 'tif', 'tiff', 'gif') THEN 'image' WHEN e IN ('cr2', 'cr3', 'nef', 'arw', 'dng', 'orf', 'rw2') THEN 'raw' WHEN e IN ('mp4', 'mov', 'avi', 'mts', 'm2ts', '3gp', 'mpg', 'mpeg', 'wmv', 'mkv') THEN 'video' END"
_ENDED = f"{_FILES}, k AS (SELECT *, {_KIND} AS kind FROM (SELECT *, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS e FROM f))"


def _files(spark, sf):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_size") % 4 + 1).cast("int"))
    end = F.when(F.col("p_partkey") % 3 == 0, pick("JPG", "heic", "png", "txt")).when(F.col("p_partkey") % 3 == 1, pick("cr2", "MOV", "mp4", "nef")).otherwise(pick("jpeg", "mts", "dng", "tiff"))
    name = F.concat(F.when(F.col("p_size") % 11 == 0, ".").otherwise(""), F.when(F.col("p_partkey") % 4 == 0, "IMG_").otherwise("Pic"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit("."), end)
    return _t(spark, sf, "part").select(F.concat(F.lit("F"), F.floor(F.col("p_partkey") / 30).cast("string")).alias("folder"), name.alias("name"), F.col("p_size").alias("size"), F.floor("p_retailprice").alias("mtime"), F.col("p_partkey").alias("id"), "p_name")


@_query(f"WITH {_ENDED} SELECT id, e AS ending, kind, starts_with(name, '.') OR lower(name) IN ('img_4.jpg') AS ignored FROM k")
def file_kinds(spark, sf):
    n = F.col("name")
    return _files(spark, sf).select("id", files.ending(n).alias("ending"), files.kind(n).alias("kind"), files.ignored(n, ["IMG_4.jpg"]).alias("ignored"))


@_query(f"WITH {_FILES}, l AS (SELECT folder, name || '|' || size || '|' || mtime AS line FROM f) SELECT folder, count(*) AS files, md5(count(*) || '/' || string_agg(line, '/' ORDER BY line)) AS signature FROM l GROUP BY 1")
def listing_signatures(spark, sf):
    return files.signatures(_files(spark, sf))


@_query(f"""WITH {_FILES}, l AS (SELECT folder, name || '|' || size || '|' || mtime AS line, name || '|' || (CASE WHEN size = 7 THEN 8 ELSE size END) || '|' || mtime AS later FROM f),
s AS (SELECT folder, string_agg(line, '/' ORDER BY line) AS a, string_agg(later, '/' ORDER BY later) AS b FROM l GROUP BY 1) SELECT folder FROM s WHERE a <> b""")
def quick_sync(spark, sf):
    known = files.signatures(_files(spark, sf)).select("folder", "signature")
    now = files.signatures(_files(spark, sf).withColumn("size", F.when(F.col("size") == 7, 8).otherwise(F.col("size"))))
    return now.join(known, ["folder", "signature"], "left_anti").select("folder")


@_query(f"""WITH {_ENDED}, s AS (SELECT *, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM k WHERE kind IS NOT NULL),
i AS (SELECT *, coalesce(first(CASE WHEN kind = 'image' THEN name END) OVER (PARTITION BY folder, stem ORDER BY CASE WHEN kind = 'image' THEN list_position(['jpg', 'jpeg', 'heic', 'heif', 'png', 'webp', 'tif', 'tiff', 'gif'], e) ELSE 99 END, name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
  min(CASE WHEN kind = 'raw' THEN name END) OVER (PARTITION BY folder, stem)) AS first_, min(CASE WHEN e = 'mov' THEN name END) OVER (PARTITION BY folder, stem) AS mov FROM s),
m AS (SELECT *, CASE WHEN name = first_ OR (kind = 'raw' AND first_ IS NOT NULL) OR (name = mov AND lower(regexp_extract(first_, '\\.([^.]*)$', 1)) IN ('heic', 'heif')) THEN first_ ELSE name END AS medium FROM i)
SELECT folder, name, medium, CASE WHEN name = medium THEN 'primary' WHEN kind = 'raw' THEN 'raw' ELSE 'motion' END AS role, CASE WHEN kind = 'video' AND name = medium THEN 'video' ELSE 'image' END AS medium_kind FROM m""")
def file_groups(spark, sf):
    return files.grouped(_files(spark, sf))


@_query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'new' WHEN o_orderkey % 4 <> 0 THEN 'unchanged' WHEN o_orderkey % 8 = 0 THEN 'touched' ELSE 'changed' END AS state FROM orders""")
def change_steps(spark, sf):
    k = F.col("o_orderkey")
    o = _t(spark, sf, "orders").select(k.alias("id"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("mtime"), F.md5(F.col("o_orderstatus").cast("binary")).alias("quick"))
    seen = o.select("id", "size", F.when(F.col("id") % 4 == 0, F.date_add("mtime", 1)).otherwise(F.to_date("mtime")).alias("mtime"), F.when((F.col("id") % 4 == 0) & (F.col("id") % 8 != 0), "x").otherwise(F.col("quick")).alias("quick"))
    return files.changed(o.withColumn("mtime", F.to_date("mtime")).where("id % 10 <> 0"), seen, "id")


@_query(f"""WITH {_FILES}, a AS (SELECT 'a/' || id AS path, size, p_name FROM f WHERE id % 3 <> 0 UNION ALL SELECT 's/' || id, size, p_name FROM f WHERE id % 3 = 0),
b AS (SELECT 'b/' || id AS path, size, p_name FROM f WHERE id % 3 = 1 UNION ALL SELECT 's/' || id, size, p_name FROM f WHERE id % 3 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY size, p_name ORDER BY path) AS n FROM a WHERE path NOT IN (SELECT path FROM b)), h AS (SELECT *, row_number() OVER (PARTITION BY size, p_name ORDER BY path) AS n FROM b WHERE path NOT IN (SELECT path FROM a))
SELECT g.path AS old, h.path AS "new" FROM g JOIN h USING (size, p_name, n)""")
def moved_files(spark, sf):
    f = _files(spark, sf)
    at = lambda letter, keep: f.where(keep).select(F.concat(F.lit(letter + "/"), F.col("id").cast("string")).alias("path"), "size", "p_name")
    stay = at("s", "id % 3 = 0")
    return files.moved(at("a", "id % 3 <> 0").union(stay), at("b", "id % 3 = 1").union(stay), "path", ["size", "p_name"])


@_query(f"WITH {_FILES}, k AS (SELECT * FROM f WHERE folder NOT LIKE '%7'), g AS (SELECT * FROM k WHERE size IN (5, 9)) SELECT id, folder, (SELECT count(*) FROM g) / (SELECT count(*) FROM k) > 0.5 AS paused FROM g")
def vanished_files(spark, sf):
    f = _files(spark, sf)
    return files.vanished(f, f.where("size not in (5, 9)"), f.where("folder not like '%7'"), "folder", "id", 0.5, 0)


@_query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN 'present' WHEN value > 50 THEN 'restored' WHEN ts < TIMESTAMP '2024-01-29' - INTERVAL 10 DAY THEN 'purge' ELSE 'missing' END AS state FROM events""")
def missing_grace(spark, sf):
    e = _t(spark, sf, "events").withColumn("since", F.when(F.col("event_type") == "error", F.col("ts")))
    return files.grace(e, "since", F.lit("2024-01-29").cast("timestamp"), 10, F.col("value") > 50).select("event_id", "state")


_NAMED = "n AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'IMG_' || strftime(o_orderdate, '%Y%m%d') || '_101530.jpg' WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || ' Trip' WHEN 2 THEN 'Sommer ' || strftime(o_orderdate, '%Y') ELSE 'misc' || o_orderkey END AS name, o_orderdate FROM orders)"


@_query(f"WITH {_NAMED} SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '10:15:30' HOUR TO SECOND WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN date_trunc('year', o_orderdate) END AS TIMESTAMP) AS taken FROM n".replace("INTERVAL '10:15:30' HOUR TO SECOND", "to_seconds(36930)"))
def dates_in_names(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    name = F.when(k % 4 == 0, F.concat(F.lit("IMG_"), F.date_format(d, "yyyyMMdd"), F.lit("_101530.jpg"))).when(k % 4 == 1, F.concat(F.date_format(d, "yyyy-MM"), F.lit(" Trip"))).when(k % 4 == 2, F.concat(F.lit("Sommer "), F.date_format(d, "yyyy"))).otherwise(F.concat(F.lit("misc "), k.cast("string")))
    return _t(spark, sf, "orders").select(k, F.when(k % 4 == 3, F.lit(None).cast("timestamp")).otherwise(files.date_in(name)).alias("taken"))


@_query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) - CASE WHEN event_id % 5 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS taken FROM events")
def exif_times(spark, sf):
    k, text = F.col("event_id"), F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    raw = F.when(k % 5 == 0, "0000:00:00 00:00:00").when(k % 5 == 1, F.concat(text, F.lit("+02:00"))).when(k % 5 == 2, F.concat(text, F.lit("Z"))).otherwise(text)
    return _t(spark, sf, "events").select(k, files.exif_time(raw).alias("taken"))


@_query(f"""WITH {_FILES}, g AS (SELECT size, id, row_number() OVER (PARTITION BY size ORDER BY id % 7 DESC, id % 3 DESC, regexp_matches(name, '^IMG_1'), mtime DESC, id) AS place FROM f)
SELECT b.id AS copy, a.id AS copy_of FROM g a JOIN g b USING (size) WHERE a.place = 1 AND b.place > 1""".replace("regexp_matches(name, '^IMG_1')", "regexp_matches(name, '^signal-')"))
def hidden_copies(spark, sf):
    f = _files(spark, sf).select("size", F.col("id").alias("key"), "name", (F.col("id") % 7).alias("pixels"), (F.col("id") % 3).alias("metadata"), F.col("mtime"))
    return files.copies(f.withColumn("group", F.col("size")).drop("size").withColumnRenamed("mtime", "size"), "group")


@_query("SELECT p_partkey, CASE WHEN p_size % 8 >= 4 THEN p_partkey % 50 ELSE p_size END AS width, CASE WHEN p_size % 8 >= 4 THEN p_size ELSE p_partkey % 50 END AS height FROM part")
def upright_sizes(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", files.upright(F.col("p_size").cast("long"), F.col("p_partkey") % 50, F.col("p_size") % 8 + 1).alias("x")).select("p_partkey", "x.*")
