"""Trees, threads and replacing writes without cuts."""

import pytest

from lumenlake.operators import filters, library, search


def test_a_chain_deeper_than_any_bound(spark):
    edges = [(i, i - 1 if i else None) for i in range(130)] + [(500, 400), (None, 3), (7, 6)]
    got = [tuple(r) for r in filters.closure(spark.createDataFrame(edges, "c long, p long"), "c", "p").collect()]
    want = [(i, j, i - j) for i in range(130) for j in range(i + 1)] + [(500, 500, 0), (500, 400, 1)]
    assert sorted(got) == sorted(want)
    assert filters.closure(spark.createDataFrame([], "c long, p long"), "c", "p").count() == 0
    for ring in ([(1, 1)], [(1, 2), (2, 3), (3, 1), (9, 1)]):
        with pytest.raises(ValueError):
            filters.closure(spark.createDataFrame(ring, "c long, p long"), "c", "p")


def test_answers_go_to_the_comment_that_began(spark):
    rows = [(1, None, False), (2, 1, False), (3, 2, False), (4, 3, True), (5, 4, False), (6, 99, False), (7, None, True), (8, 7, True)]
    got = {tuple(r) for r in library.threads(spark.createDataFrame(rows, "comment long, parent long, deleted boolean")).collect()}
    assert got == {(1, None, False), (2, 1, False), (3, 1, False), (5, 1, False), (6, 99, False)}
    with pytest.raises(ValueError):
        library.threads(spark.createDataFrame([(1, 2, False), (2, 1, False)], "comment long, parent long, deleted boolean"))


def test_replacing_writes(spark):
    df = lambda *rows: spark.createDataFrame(rows, "a long, b string, v long")
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    old, new = df((1, "x", 1), (None, "y", 2), (3, None, 3), (3, None, 4)), df((1, "x", 9), (1, "x", 8), (None, "y", 7), (None, None, 5), (None, None, 6))
    key = ["a", "b"]
    assert rows(library.upserted(old, new, key)) == sorted([(1, "x", 8), (None, "y", 7), (3, None, 3), (3, None, 4), (None, None, 5)], key=repr)
    assert rows(library.written_once(old, new, key)) == sorted([(1, "x", 1), (None, "y", 2), (3, None, 3), (3, None, 4), (None, None, 5)], key=repr)
    assert rows(library.replaced(old, new, key)) == sorted([(1, "x", 9), (1, "x", 8), (None, "y", 7), (3, None, 3), (3, None, 4), (None, None, 5), (None, None, 6)], key=repr)
    assert rows(library.upserted(old, new.limit(0), key)) == rows(old) and rows(library.written_once(old.limit(0), old, key)) == sorted([(1, "x", 1), (None, "y", 2), (3, None, 3)], key=repr)


def test_pairs_are_dealt_to_as_many_tasks_as_the_links_need(spark, monkeypatch):
    monkeypatch.setattr(search, "LINKS", 5, raising=False)
    rows = [(i // 3, i % 7) for i in range(300)] + [(None, 1), (None, 2), (5, None), (0, 0)]
    found = search.together(spark.createDataFrame(rows, "o long, i long"), "o", "i", 2)
    assert "hashpartitioning(o" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 61)" in plan
    sets = {}
    for o, i in rows:
        if o is not None and i is not None:
            sets.setdefault(o, set()).add(i)
    want = {(a, b): n for a in range(7) for b in range(a + 1, 7) if (n := sum({a, b} <= s for s in sets.values())) >= 2}
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == want
