"""Albums, comments, chapters, memories and stages: edge cases, and greedy choices against plain Python."""

from datetime import datetime

from pyspark.sql import functions as F

from lumenlake.operators import album_queries as Q
from lumenlake.operators import library


def test_thinned(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_brand", "p_partkey", F.xxhash64("p_name").alias("p"), "p_retailprice").collect()
    want, books = set(), {}
    for r in rows:
        books.setdefault(r["p_brand"], []).append(r)
    for book, some in books.items():
        kept = []
        for r in sorted(some, key=lambda r: (-r["p_retailprice"], r["p_partkey"])):
            if all(bin((k["p"] ^ r["p"]) & (2**64 - 1)).count("1") > 24 for k in kept):
                kept.append(r)
        want |= {(book, r["p_partkey"]) for r in kept}
    assert {tuple(r) for r in Q.book_thinned(spark, sf).collect()} == want and len(want) < len(rows)


def test_threads(spark):
    rows = spark.createDataFrame([(1, None, True), (2, 1, False), (3, 2, False), (4, None, True), (5, 4, True), (6, None, None)], "comment long, parent long, deleted boolean")
    assert sorted(tuple(r) for r in library.threads(rows).collect() if r) == sorted([(1, None, True), (2, 1, False), (3, 1, False), (6, None, False)], key=str)


def test_collage(spark):
    albums = spark.createDataFrame([(1, None, "a"), (2, 1, "a/b"), (3, 1, "a/c"), (4, 2, "a/b/d"), (5, None, "z")], "album long, parent long, path string")
    media = spark.createDataFrame([(10, 4, 1), (11, 3, 5), (12, 3, 7), (13, None, 9)], "medium long, album long, at int")
    got = {r["album"]: (r["media"], r["children"], r["collage"]) for r in library.album_tree(albums, media).collect()}
    assert got == {1: (0, 2, [12, 10]), 2: (0, 1, [10]), 3: (2, 0, [12]), 4: (1, 0, [10]), 5: (0, 0, [])}
    assert library.album_tree(albums.limit(0), media).count() == 0


def test_memories_fall_back_to_the_week(spark):
    rows = spark.createDataFrame([(1, datetime(2019, 12, 31), 1), (2, datetime(2018, 1, 3), 1), (3, datetime(2018, 1, 9), 1), (4, None, 1), (5, datetime(2020, 1, 1), None)], "k long, at timestamp, album long")
    ask = lambda y, d: {(r["year"], r["k"], r["from_week"]) for r in library.on_this_day(rows, "k", "at", "album", F.lit(1), y, 1, d).collect()}
    assert ask(2020, 1) == {(2019, 1, True), (2018, 2, True)} and ask(2021, 1) == {(2020, 5, False)} and ask(2018, 1) == set()


def test_empty_and_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, 1), (1, None, None, 2)], "user_id long, place string, ts timestamp, event_id long")
    trips, members = library.away(rows, "user_id", "place", "ts", "event_id")
    assert trips.count() == members.count() == 0
    assert {r["user_id"]: r["home"] for r in library.homes(rows, "user_id", "place").collect()} == {None: None, 1: None}
    assert library.shelves(rows.limit(0), {"a": F.lit(True)}).count() == 0 and library.report(rows.limit(0), {"a": (F.col("place"), F.lit(1))}, {}).count() == 0
    text = spark.createDataFrame([("One. Two.",), ("One",), ("",), (None,)], "t string")
    assert [r[0] for r in text.select(library.first_sentence(F.col("t"))).collect()] == ["One.", "One.", ".", None]
