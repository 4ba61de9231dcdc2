"""Registered queries over books of pictures, which are made of the events by a fixed rule; with SQL where it has words for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import books
from lumenlake.operators.registry import QUERIES, _query, _t

_GAP = 6 * 60


def _shots(spark, sf):
    e, key = _t(spark, sf, "events"), F.col("event_id")
    tag = lambda by, n: F.concat(F.lit(f"t{by}."), (key * by % n).cast("string"))
    return e.select(
        (F.col("user_id") % 20).alias("book"), key.alias("id"), F.when(key % 9 == 0, F.date_trunc("month", "ts")).otherwise(F.col("ts")).alias("taken_at"), (key % 9 == 0).alias("guessed"), (key * 7 % 5).alias("people"), F.col("event_type").alias("caption"),
        (key * 3 % 40 + 10).alias("width"), (key * 11 % 40 + 10).alias("height"), F.array(tag(3, 17), tag(5, 23), tag(7, 11)).alias("tags"), F.when(key % 12 == 0, F.repeat(F.lit("ab "), (key % 20).cast("int"))).alias("ocr"), F.when(key % 3 == 0, key / 100).alias("latitude"),
    )


@_query(f"""WITH s AS (SELECT user_id % 20 AS book, event_id AS id, ts FROM events WHERE event_id % 9 > 0),
c AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {_GAP * 60_000_000} THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY book ORDER BY ts, id))
SELECT book, id, CAST(sum(cut) OVER (PARTITION BY book ORDER BY ts, id) AS INT) AS moment FROM c""")
def book_moments(spark, sf):
    return books.moments(_shots(spark, sf).where("not guessed"), _GAP).select("book", "id", "moment")


@_query(f"""WITH s AS (SELECT user_id % 20 AS book, event_id AS id, ts, event_id % 9 = 0 AS guessed, ['t3.' || event_id * 3 % 17, 't5.' || event_id * 5 % 23, 't7.' || event_id * 7 % 11] AS tags FROM events),
c AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {_GAP * 60_000_000} THEN 1 ELSE 0 END AS cut FROM s WHERE NOT guessed WINDOW w AS (PARTITION BY book ORDER BY ts, id)),
m AS (SELECT *, sum(cut) OVER (PARTITION BY book ORDER BY ts, id) AS moment FROM c), z AS (SELECT book, moment, max(ts) AS finish FROM m GROUP BY ALL),
l AS (SELECT g.book, g.id, m.moment, max(len(list_intersect(g.tags, m.tags)) / (6.0 - len(list_intersect(g.tags, m.tags)))) AS alike FROM s g JOIN m ON m.book = g.book WHERE g.guessed GROUP BY ALL),
h AS (SELECT book, id, arg_min(moment, (-alike, moment)) AS moment FROM l GROUP BY ALL)
SELECT book, id, ts AS taken_at FROM s WHERE NOT guessed UNION ALL SELECT h.book, h.id, finish FROM h JOIN z USING (book, moment)""")
def book_placed(spark, sf):
    return books.placed(_shots(spark, sf), _GAP).select("book", "id", "taken_at")


def book_chosen(spark, sf):
    return books.chosen(_shots(spark, sf).where("not guessed"), 0.4, 120, 7, _GAP).select("book", "id", "taken_at")


def book_pages(spark, sf):
    return books.pages(books.chosen(_shots(spark, sf).where("not guessed"), 0.4, 120, 7, _GAP), _GAP)


# Choices by the seed and pages have no SQL: tests/test_books.py holds them against plain Python.
QUERIES.update(book_chosen=book_chosen, book_pages=book_pages)
