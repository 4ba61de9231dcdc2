"""Small conditions on nulls and edges."""

import datetime as dt

from pyspark.sql import functions as F

from lumenlake.operators import conditions, places


def test_conditions_are_never_null(spark):
    df = spark.createDataFrame([(85.05, "exif", True, 40, 0.6), (-85.06, "folder_name", False, 39, 0.9), (None, None, None, None, 0.9), (0.0, "gps", None, 40, None)], "lat double, source string, flag boolean, pixels int, score double")
    got = [tuple(r) for r in df.select(conditions.on_map(F.col("lat")), conditions.certain(F.col("source")), conditions.unless(F.col("flag")), conditions.admitted(F.col("pixels"), F.col("score"))).collect()]
    assert got == [(True, True, False, True), (False, False, True, False), (False, False, True, False), (True, True, True, False)]


def test_open_groups_and_captions(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, None), (None, 13)], "group_id long, medium long")
    hidden = spark.createDataFrame([(11,), (11,), (None,)], "medium long")
    assert [tuple(r) for r in conditions.open_groups(members, hidden).collect()] == [(2, 2)]
    assert sorted(tuple(r) for r in conditions.open_groups(members, hidden.limit(0)).collect()) == [(1, 2), (2, 2)]
    texts = spark.createDataFrame([("A dog.", ["dog", None, "sea"]), ("A dog.", []), (None, None), (None, ["x"]), ("c", [None])], "c string, t array<string>")
    assert [r[0] for r in texts.select(conditions.caption_text(F.col("c"), F.col("t"))).collect()] == ["A dog. Stichwörter: dog, sea.", "A dog.", "", " Stichwörter: x.", "c"]


def test_what_goes_on_waiting(spark):
    paths = ["r.jpg", "a/1.jpg", "a/2.jpg", "a/b/3.jpg", "gone/4.jpg", "bad/5.jpg", "bad/c/6.jpg", "badly/7.jpg", None]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    pending = df([(p, i) for i, p in enumerate(paths)], "path string, n int")
    folders = df([("", True), ("a", True), ("a", True), ("bad", False)], "folder string, readable boolean")
    listed = df([("r.jpg",), ("a/1.jpg",), ("a/1.jpg",), ("a/b/3.jpg",)], "path string")
    assert {r["path"] for r in conditions.still_waiting(pending, folders, listed).collect()} == {"r.jpg", "a/1.jpg", "bad/5.jpg", "bad/c/6.jpg"}
    nothing = df([("", False)], "folder string, readable boolean")  # the root could not be read: that proves nothing
    assert conditions.still_waiting(pending, nothing, listed.limit(0)).count() == 8
    assert conditions.still_waiting(pending.limit(0), folders, listed).count() == 0


def test_newest_lines(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, at, "a"), (2, at, "a/b"), (3, None, "a"), (4, at, "ab"), (5, at, None)], "line long, at timestamp, album string")
    assert [r["line"] for r in conditions.newest_lines(log, 9, "a").collect()] == [2, 1] and [r["line"] for r in conditions.newest_lines(log, 2).collect()] == [5, 4]


def test_results_that_rest_on_something_new(spark):
    results = spark.createDataFrame([(m, s, 1) for m in (1, 2) for s in ("t", "a", "c", "x")] + [(None, "a", 1)], "medium long, stage string, n int")
    changed = spark.createDataFrame([(1, "t"), (1, "t"), (2, "a"), (None, "t"), (3, "t")], "medium long, stage string")
    got = {(r["medium"], r["stage"]) for r in conditions.invalidated(results, changed, {"a": "t", "c": "a"}).collect()}
    assert got == {(1, "t"), (1, "x"), (2, "t"), (2, "a"), (2, "x"), (None, "a")}
    assert conditions.invalidated(results, changed, {}).count() == 9 and conditions.invalidated(results, changed, {"a": "c", "c": "a"}).count() == 8


def test_places_of_a_new_version(spark):
    media = spark.createDataFrame([(1, 10.0, 10.0, "a/b", 5, False, 1), (2, None, None, "a/b/c", None, None, None), (3, None, 1.0, "x", 7, True, 1), (4, 10.0, 10.0, "a", 5, False, 2), (5, 50.0, 50.0, "a", 5, False, 1), (6, None, None, None, 5, True, 0)], "key long, lat double, lon double, path string, place long, estimated boolean, version int")
    towns = spark.createDataFrame([(70, 10.1, 10.1), (71, 10.3, 10.0), (72, None, 3.0)], "town long, lat double, lon double")
    owners = spark.createDataFrame([("a", 80), ("a/b", 81)], "folder string, town long")
    got = {r["key"]: (r["place"], r["estimated"], r["version"]) for r in places.placed_anew(media, towns, owners, 2, 50.0).collect()}
    assert got == {1: (70, False, 2), 2: (81, True, 2), 3: (None, False, 2), 4: (5, False, 2), 5: (None, False, 2), 6: (None, False, 2)}
    assert places.placed_anew(media.limit(0), towns, owners, 2, 50.0).count() == 0


def test_points_and_towns_of_one_place_meet_once(spark):
    """Without that, 3.6 thousand million pairs."""
    import time

    began = time.monotonic()
    at = lambda lon: F.struct(F.lit(89.5).alias("lat"), lon.alias("lon"))
    points = spark.range(60_000).select(F.col("id").alias("key"), at(F.when(F.col("id") % 2 == 0, -179.9).otherwise(10.0)).alias("x")).select("key", "x.*")
    towns = spark.range(60_000).select((F.col("id") + 7).alias("town"), at(F.when(F.col("id") < 30_000, 179.9).otherwise(10.0)).alias("x")).select("town", "x.*")
    got = places.nearest_town(points, "key", towns, "town", 50.0).groupBy(F.col("key") % 2, "town").agg(F.count(F.lit(1)), F.max("km")).collect()
    assert sorted((r[0], r[1], r[2], r[3] < 1) for r in got) == [(0, 7, 30_000, True), (1, 30_007, 30_000, True)]
    assert time.monotonic() - began < 60
