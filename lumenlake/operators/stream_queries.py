"""Registered queries that bring the events as a stream of several files and batches, each beside the SQL of the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators.groups import shared_path
from lumenlake.operators.registry import _query, _t
from lumenlake.streaming import states

_LOOK, _SPAN, _WINDOW, _STEP = 6 * 3600, 24 * 60, 3600, 600


def _streamed(spark, rows, time, transform):
    source, files = states.dealt(rows, time)
    return states.run(spark, source, rows.schema, transform, shared_path(spark), files)


@_query(f"""WITH o AS (SELECT CAST(user_id % 100 AS VARCHAR) AS path, event_id % 3 // 2 AS size, ts, event_id FROM events),
c AS (SELECT *, CASE WHEN size IS DISTINCT FROM lag(size) OVER w THEN 1 ELSE 0 END AS cut FROM o WINDOW w AS (PARTITION BY path ORDER BY ts, size)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY path ORDER BY ts, size) AS run FROM c),
f AS (SELECT *, min(ts) OVER (PARTITION BY path, run) AS first_seen FROM r),
d AS (SELECT path, run, any_value(size) AS size, first_seen, min(ts) AS ready_at FROM f WHERE epoch_us(ts) - epoch_us(first_seen) >= {_LOOK * 1_000_000} GROUP BY path, run, first_seen)
SELECT path, size, first_seen, ready_at FROM (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY ready_at) AS before FROM d) WHERE size IS DISTINCT FROM before""")
def files_arrived(spark, sf):
    e = _t(spark, sf, "events")
    looks = e.select((F.col("user_id") % 100).cast("string").alias("path"), F.floor(F.col("event_id") % 3 / 2).alias("size"), F.lit(None).cast("timestamp").alias("modified"), F.col("ts").alias("seen"))
    return _streamed(spark, looks, "seen", lambda x: states.stable(x, seconds=_LOOK, forget=365 * 86_400)).select("path", "size", "first_seen", "ready_at")


@_query(f"""WITH n AS (SELECT event_id AS id, user_id % 40 AS "user", event_type AS kind, event_id % 5 AS actor, ts AS t, event_id % 7 = 0 AS read FROM events),
o AS (SELECT *, sum(CAST(read AS INT)) OVER w AS reads, lead(read) OVER w AS next_read, lead(t) OVER w AS next_at FROM n WINDOW w AS (PARTITION BY "user", kind ORDER BY t, id)),
c AS (SELECT *, CASE WHEN epoch_us(t) - epoch_us(lag(t) OVER w) < {_SPAN * 60_000_000} THEN 0 ELSE 1 END AS cut FROM o WHERE NOT read WINDOW w AS (PARTITION BY "user", kind, reads ORDER BY t, id)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY "user", kind, reads ORDER BY t, id) AS island FROM c),
a AS (SELECT "user", kind, reads, island, list(actor ORDER BY last) AS actors FROM (SELECT "user", kind, reads, island, actor, max((t, id)) AS last FROM i GROUP BY ALL) GROUP BY ALL)
SELECT "user", kind, min(t) AS started, max(t) AS updated, count(*) AS n, any_value(actors) AS actors, arg_max(coalesce(next_read AND epoch_us(next_at) - epoch_us(t) < {_SPAN * 60_000_000}, false), (t, id)) AS read
FROM i JOIN a USING ("user", kind, reads, island) GROUP BY "user", kind, reads, island""")
def notes_bundled(spark, sf):
    e, key = _t(spark, sf, "events"), F.col("event_id")
    notes = e.select(key.alias("id"), (F.col("user_id") % 40).alias("user"), F.col("event_type").alias("kind"), F.lit(0).alias("target"), (key % 5).alias("actor"), F.col("ts").alias("at"), (key % 7 == 0).alias("read"))
    return states.latest(_streamed(spark, notes, "at", lambda x: states.bundled(x, minutes=_SPAN))).drop("target")


@_query(f"""WITH d AS (SELECT event_type AS stage, user_id AS task, CAST(ceil(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events WHERE event_id % 11 > 0),
t AS (SELECT stage, task, unnest(range((ms + {_STEP * 1000 - 1}) // {_STEP * 1000} * {_STEP * 1000}, ms + {_WINDOW * 1000} + 1, {_STEP * 1000})) AS tick FROM d)
SELECT stage, make_timestamp(tick * 1000) AS tick, count(DISTINCT task) AS done FROM t WHERE tick <= (SELECT max(epoch_us(ts)) // 1000 - 10000 FROM events WHERE event_id % 11 > 0) GROUP BY ALL""")
def done_lately(spark, sf):
    done = _t(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("task"), F.col("ts").alias("at"), (F.col("event_id") % 11 == 0).alias("failed"))
    told = _streamed(spark, done, "at", lambda x: states.last_minute(x, window=_WINDOW, step=_STEP, salts=4))
    return told.groupBy("stage", "tick").agg(F.sum("done").alias("done"))
