"""Pages of faces and notifications on awkward rows."""

import datetime as dt

import pytest

from lumenlake.operators import listings

T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def library(spark):
    faces = [
        (1, 10, None, None, None, 5, 100, 0.5, 7, 0.2, 1, None, 0.3), (2, 10, None, None, None, 5, 100, 0.9, 7, None, 2, None, 0.1), (3, 11, None, None, None, 5, None, None, 8, 0.1, 3, 4, 0.2), (4, 12, None, None, None, 5, 900, 0.9, 7, 0.1, 4, None, 0.2),
        (5, 10, None, None, None, 6, 50, 0.5, None, None, 5, None, None), (6, 10, 7, "auto", True, None, 50, 0.5, None, None, 6, None, 0.0), (7, 11, 7, "user", False, None, 50, 0.5, None, None, 7, None, 0.0), (8, 11, 7, "auto", False, None, 50, 0.5, None, None, 8, 2, 0.9), (9, None, 7, "auto", False, None, 1, 0.1, None, None, None, None, None),
    ]
    names = "face long, medium long, person long, assigned_by string, trusted boolean, cluster long, pixels int, score double, suggested long, distance double, created long, second int, left double"
    shown = [(10, T), (11, dt.datetime(2023, 5, 5)), (11, dt.datetime(2023, 5, 5)), (13, None)]
    people = [(7, "Ada", None), (8, "Bob", True)]
    return spark.createDataFrame(faces, names), spark.createDataFrame(shown, "medium long, at timestamp"), spark.createDataFrame(people, "person long, name string, hidden boolean")


def test_pages_of_faces(library):
    faces, shown, people = library
    rows = lambda df: [tuple(r) for r in df.orderBy("place").collect()]
    assert rows(listings.groups(faces, shown, 0, 5, most=2)) == [(5, 3, [2, 1], 1, False)]  # medium 12 is not shown
    assert rows(listings.groups(faces, shown, 1, 5)) == []
    assert [r[:4] for r in rows(listings.questions(faces, people, shown, 0, 1))] == [(1, 7, "Ada", 0.2)]
    page = listings.questions(faces, people, shown, 0, 1).collect()[0]
    assert page["more"] and not listings.questions(faces, people, shown, 1, 1).collect()[0]["more"]
    assert [r[0] for r in rows(listings.faces_of(faces, shown, 7, 0, 9))] == [6, 7, 8]
    assert {r[0] for r in rows(listings.faces_of(faces, shown, 7, 0, 9, "auto"))} == {6, 8}
    assert [r[0] for r in rows(listings.faces_of(faces, shown, 7, 0, 9, "twice"))] == [7]  # 8 is a video's
    assert [r["medium"] for r in listings.media_of(faces, shown, 7, None, 9).collect()] == [10, 11]
    assert [r["medium"] for r in listings.media_of(faces, shown, 7, (T, 10), 9).collect()] == [11]
    assert [(r[0], r[2]) for r in rows(listings.faces_in(faces, people, 10))] == [(6, "Ada"), (2, None), (1, None), (5, None)]
    none = faces.limit(0)
    assert all(df.count() == 0 for df in (listings.groups(none, shown, 0, 9), listings.questions(none, people, shown, 0, 9), listings.faces_of(none, shown, 7, 0, 9), listings.media_of(none, shown, 7, None, 9), listings.faces_in(none, people, 10)))


def test_notifications(spark, library):
    people = library[2]
    notes = spark.createDataFrame(
        [(1, 5, "like", 10, None, None, [8, 99, 7], 3, T, None), (2, 5, "answer", None, 4, 21, [], 1, dt.datetime(2024, 1, 2), T), (3, 5, "answer", 77, None, 22, None, 1, None, None), (4, 6, "like", None, None, None, [7], 1, T, None)],
        "note long, user long, kind string, medium long, album long, comment long, actors array<long>, n int, updated timestamp, read_at timestamp",
    )
    media, albums = spark.createDataFrame([(10, 3), (10, 3)], "medium long, album long"), spark.createDataFrame([(3, "a"), (4, "b")], "album long, path string")
    comments = spark.createDataFrame([(21, "hello", None), (22, "gone", True)], "comment long, body string, deleted boolean")
    got = {r["note"]: r for r in listings.notifications(notes, 5, people, media, albums, comments).collect()}
    assert {n: (r["actors"], r["album"], r["path"], r["excerpt"], r["unread"], r["place"]) for n, r in got.items()} == {2: ([], 4, "b", "hello", False, 1), 1: (["Ada", "Bob"], 3, "a", None, True, 2), 3: ([], None, None, None, True, 3)}
    page = listings.notifications(notes, 5, people, media, albums, comments, before="2024-01-02", limit=1).collect()
    assert [(r["note"], r["more"]) for r in page] == [(1, False)]
    after = {r["note"]: r["read_at"] for r in listings.read(notes, 5, "2024-03-03", [1, 4]).collect()}
    assert after == {1: dt.datetime(2024, 3, 3), 2: T, 3: None, 4: None}
    assert listings.notifications(notes.limit(0), 5, people, media, albums, comments).count() == 0


def test_cursors():
    word = listings.cursor(dt.datetime(2024, 1, 2, 3, 4, 5, 6, tzinfo=dt.UTC), 42)
    assert "=" not in word and listings.cursor_of(word) == (dt.datetime(2024, 1, 2, 3, 4, 5, 6, tzinfo=dt.UTC), 42)
    for bad in ("", "x", "é", word[:-3], "bm90aGluZw"):
        with pytest.raises(ValueError):
            listings.cursor_of(bad)
