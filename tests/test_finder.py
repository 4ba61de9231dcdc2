"""What a query means, filters, the whole search, and the gazetteer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import finder, fulltext, gazetteer, postings, trigrams
from lumenlake.operators.groups import shared_path


@pytest.mark.parametrize(
    "query,text,since,until,kind",
    [
        ("Hund", "Hund", None, None, None),
        ("Strand 2019", "Strand", "2019-01-01", "2020-01-01", None),
        ("Strand aus 2019", "Strand", "2019-01-01", "2020-01-01", None),
        ("2018-2020 Hund", "Hund", "2018-01-01", "2021-01-01", None),
        ("Hund 2020 bis 2018", "Hund", "2018-01-01", "2021-01-01", None),
        ("Hund 2018 – 2020", "Hund", "2018-01-01", "2021-01-01", None),
        ("Winter 2020 Schnee", "Schnee", "2020-12-01", "2021-03-01", None),
        ("Jan 2024", "", "2024-01-01", "2024-02-01", None),
        ("Schnee im Dezember 2020", "Schnee", "2020-12-01", "2021-01-01", None),
        ("nur Fotos von Oma im Jahr 1999", "von Oma", "1999-01-01", "2000-01-01", "image"),
        ("Videos mit", "", None, None, "video"),
        ("Sommer", "Sommer", None, None, None),
        ("1949 2100 12345 Haus", "1949 2100 12345 Haus", None, None, None),
        ("2001 Sommer 2005", "2001", "2005-06-01", "2005-09-01", None),
        ("", "", None, None, None),
    ],
)
def test_periods_and_kinds(query, text, since, until, kind):
    said = finder.parsed(query)
    assert (said.text, said.since, said.until, said.kind) == (text, since, until, kind)


def test_the_older_reader_knows_them_too():
    for query, since, until in (("Winter 2020", "2020-12-01", "2021-03-01"), ("Jan 2024", "2024-01-01", "2024-02-01"), ("2018 - 2020", "2018-01-01", "2021-01-01"), ("2018 bis 2020", "2018-01-01", "2021-01-01"), ("Dezember 2020", "2020-12-01", "2021-01-01")):
        said = fulltext.understood(query)
        assert (said.rest, said.since, said.until) == ("", since, until)


def test_persons_in_a_query(spark):
    people = spark.createDataFrame([(1, "Oma", None), (2, "Lena", False), (3, "Lena Marie", False), (4, "Geist", True), (5, "lena", False), (6, None, False)], "person long, name string, hidden boolean")
    assert finder.persons_in("Oma und Lena Marie am Strand", people) == ("am Strand", ["Oma", "Lena Marie"], [1, 3])
    assert finder.persons_in("Strand mit LENA, oma und oma", people) == ("Strand ,", ["LENA", "oma", "oma"], [2, 1])
    assert finder.persons_in("Geist im Haus", people) == ("Geist im Haus", [], [])
    assert finder.persons_in("42 !", people) == ("42 !", [], [])


def test_places_in_a_query(spark):
    places = spark.createDataFrame([(1, ["bad tölz", "bayern"]), (2, ["bad"]), (3, ["essen"]), (4, ["toskana", "italien"]), (5, None)], "id long, keys array<string>")
    used = spark.createDataFrame([(1,), (2,), (4,), (4,), (None,)], "place long")
    assert gazetteer.places_in("Hund aus Bad Tölz", places, used) == ("Hund", ["Bad Tölz"], ["bad tölz"])
    assert gazetteer.places_in("Essen in der Toskana in Italien", places, used) == ("Essen in der", ["Toskana", "Italien"], ["toskana", "italien"])
    assert gazetteer.places_in("Bad bad", places, used) == ("", ["Bad", "bad"], ["bad"])
    assert gazetteer.places_in("?", places, used) == ("?", [], [])


def test_keys_and_names(spark):
    rows = spark.createDataFrame([(["Moskau", "Москва", "Au", " Köln ", "köln", "Q123", None, "São Tomé", "東京"],), ([],)], "names array<string>")
    assert [r[0] for r in rows.select(gazetteer.keys_of(F.col("names"))).collect()] == [["köln", "moskau", "são tomé"], []]
    alternates = [("9", "1", "de", "Italienische Republik", "1", "", "", ""), ("8", "1", "de", "Italien", "", "1", "", ""), ("7", "1", "de", "Alt", "1", "1", "", "1"), ("6", "1", "de", "Platt", "1", "1", "1", ""), ("5", "1", "en", "Italy", "1", "1", "", ""), ("2", "2", "de", "B", "", "", "", ""), ("1", "2", "de", "A", "", "", "", ""), ("1", "x", "de", "none", "", "", "", ""), ("1", "3", "de", None, "", "", "", "1")]
    df = spark.createDataFrame(alternates, ", ".join(f"{c} string" for c in gazetteer.ALTERNATES))
    assert {tuple(r) for r in gazetteer.names_in(df).collect()} == {(1, "Italien"), (2, "A")}


def test_prepared_places_come_back(spark):
    schema = "id long, name string, region string, country string, country_code string, population long, latitude double, longitude double, keys array<string>"
    rows = [(1, "a\\b", None, "c\td", "XX", 5, 1.5, -2.25, ["x y", "z"]), (2, "n\\n\\\tq", "", None, "", 0, None, 0.0, []), (3, "line\nend \\", "r", "c", "Y", 1, 0.0, 0.0, ["k"])]
    at = shared_path(spark)
    gazetteer.write(spark.createDataFrame(rows, schema), at)
    want = [(i, n, r or None, c or None, cc, p, la, lo, k) for i, n, r, c, cc, p, la, lo, k in rows]
    assert sorted((tuple(r) for r in gazetteer.read(spark, at).collect()), key=lambda r: r[0]) == want


def test_tables_skip_comments_and_short_lines(spark):
    at = shared_path(spark)
    spark.createDataFrame([('1\tQuote " here\tx',), ("# no",), ("",), ("2",), ("3\tcr\r",)], "value string").coalesce(1).write.text(at)
    got = {r["id"]: r["name"] for r in gazetteer.table(spark, at, {"id": 0, "name": 1}).collect()}
    assert got == {"1": 'Quote " here', "2": None, "3": "cr"}


@pytest.fixture(scope="module")
def library(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    media = [
        (1, t(1), "image", "a", "Nikon", "Z", 1, "active", None), (2, t(2), "image", "a/b", None, "Z", 1, "active", None), (3, t(3), "video", "ab", None, None, 2, "active", None), (4, t(4), "image", "a", "Nikon", "Z", None, "active", None),
        (5, t(5), "image", "a", "Nikon", "Z", 1, "missing", None), (6, t(6), "image", "a", "Nikon", "Z", 1, "active", 1), (7, None, "image", "a", "Nikon", None, 2, "active", None),
    ]
    df = spark.createDataFrame
    words = [("docs", k, None, False, [("A", text, None)]) for k, text in ((1, "dog at the sea"), (2, "dog dog dog"), (3, "cat"), (5, "dog"), (6, "dog"))]
    return finder.Library(
        df(media, "key long, taken_at timestamp, kind string, album string, make string, model string, place long, status string, copy_of long"),
        df([(1, "Pisa", "Italien", ["pisa", "toskana"]), (2, "Ulm", None, ["ulm"])], "id long, name string, country string, keys array<string>"),
        df([(1, 1), (1, 2), (1, 2), (2, 1), (3, 2), (6, 1), (6, 2)], "medium long, person long"), df([(1, "Anna", False), (2, "Bert", False)], "person long, name string, hidden boolean"),
        df([(1, [1.0, 0.0]), (4, [1.0, 0.1]), (3, [-1.0, 0.0]), (2, None)], "key long, vector array<double>"), df([(1,), (2,), (3,)], "key long"),
        postings.build(df(words, f"source string, key long, moment double, german boolean, fields {postings.FIELDS}")), trigrams.build(df([(4, "dogs.jpg"), (3, "house.jpg")], "key long, name string"), "key", ["name"]), {"docs": 1.0},
    )


def test_two_persons_and_a_place(library):
    keys = lambda *a, **k: [r["key"] for r in finder.find(library, *a, **k).page.collect()]
    assert keys("Anna und Bert") == [1] and keys("Anna") == [2, 1] and keys("Bert Toskana") == [1]
    assert keys("") == [4, 3, 2, 1, 7] and keys("", offset=1, limit=2) == [3, 2]
    assert keys("Januar 2024 Videos") == [3] and keys("", finder.Filters(album="a")) == [4, 2, 1, 7] and keys("", finder.Filters(camera="Nikon Z")) == [4, 1]
    assert keys("Ulm", finder.Filters(keys=("pisa",))) == [3, 2, 1, 7]  # either place
    found = finder.find(library, "Bert in Pisa und", limit=1)
    assert found.asked.text == "und" and found.asked.places == ("Pisa",) and found.asked.persons == (2,)


def test_words_pictures_and_names_are_fused(library):
    found = finder.find(library, "dog", probe=[1.0, 0.0])
    got = [(r["key"], r["score"]) for r in found.page.collect()]
    # words: 2, 1; pictures: 1, 4 (3 is too far); names: 4. Media that are missing or copies are nowhere.
    assert got == [(1, round(1 / 62 + 1 / 61, 9)), (4, round(1 / 62 + 1 / 61, 9)), (2, round(1 / 61, 9))]
    assert [r["key"] for r in finder.find(library, "dog", probe=[1.0, 0.0], by_date=True).page.collect()] == [4, 2, 1]
    assert found.following is None and finder.find(library, "dog", limit=1).following == 1
    facets = {(r["facet"], r["value"], r["label"]): r["n"] for r in found.facets.collect()}
    assert facets == {("year", "2024", "2024"): 3, ("camera", "Nikon Z", "Nikon Z"): 2, ("camera", "Z", "Z"): 1, ("town", "Pisa", "Pisa, Italien"): 2, ("album", "a", "a"): 2, ("album", "a/b", "a/b"): 1}


def test_nothing_to_find(library):
    assert finder.find(library, "zebra").hits.count() == 0
    assert finder.find(library, "zebra").facets.count() == 0
