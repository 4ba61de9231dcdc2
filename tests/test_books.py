"""Books against plain Python, one book after the other."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import books

SCHEMA = "book long, id long, taken_at timestamp, guessed boolean, people int, caption string, width int, height int, tags array<string>, ocr string, latitude double, moment string"
T0 = dt.datetime(2024, 6, 1, 8)


def album(seed, n):
    rng = random.Random(seed)
    now, rows = T0, []
    for i in range(n):
        now += dt.timedelta(minutes=rng.choice([0, 1, 5, 20, 45, 46, 200, 900]))
        rows.append({"book": seed, "id": i * 3 + seed, "taken_at": now, "guessed": None, "people": rng.choice([None, 0, 1, 2]), "caption": rng.choice([None, "", "abc", "abcdef"]), "width": rng.choice([3, 4]), "height": rng.choice([3, 4]), "tags": rng.choice([None, [], ["a", "b", "a"], ["c", None], ["b", "c", "d"], ["e"]]), "ocr": rng.choice([None, "x" * 25, "y" * 26, "z" * 30]) if rng.random() < 0.3 else None, "latitude": rng.choice([None, 0.0, 1.5]), "moment": "x"})
    return rows


def frame(spark, *albums):
    rows = [tuple(r.values()) for a in albums for r in a]
    return spark.createDataFrame([*rows, rows[0], (None, 1, T0, *rows[0][3:]), (1, None, T0, *rows[0][3:]), (1, 99_999, None, *rows[0][3:])], SCHEMA)


def runs_of(shots, gap=45):
    out = []
    for s in sorted(shots, key=lambda s: (s["taken_at"], s["id"])):
        if out and (s["taken_at"] - out[-1][-1]["taken_at"]).total_seconds() <= gap * 60:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def drawn(seed, *parts):
    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 2**32


def stretches(items, of):
    for k in range(of):
        start = round(k * len(items) / of)
        yield items[start : max(round((k + 1) * len(items) / of), start + 1)]


def worth(s):
    return (s["people"] or 0, len(s["caption"] or ""), s["width"] * s["height"], s["id"])


def chosen(shots, share, most, seed):
    book = shots[0]["book"]
    kept = [s for r in runs_of(shots) for s in r]
    wanted = max(min(round(len(kept) * share), most, len(kept)), min(8, len(kept)))
    if wanted >= len(kept):
        return {s["id"] for s in kept}
    runs = [(i, r) for i, r in enumerate(runs_of(shots))]
    typical = max(1, min(3, round(len(kept) / len(runs))))
    of = max(1, min(-(-wanted // typical), len(runs)))
    picked = []
    for k, here in enumerate(stretches(runs, of) if of < len(runs) else [[r] for r in runs]):
        if k == 0:
            picked.append(here[0])
        elif k == of - 1:
            picked.append(here[-1])
        else:
            picked.append(max(here, key=lambda r: (len(r[1]), -r[0])) if drawn(seed, book, "m", k) < 0.6 else min(here, key=lambda r: (drawn(seed, book, r[0]), r[0])))
    total = sum(len(r) for _, r in picked)
    given = [max(1, len(r) * wanted // total) for _, r in picked]
    while sum(given) < wanted and any(g < len(r) for g, (_, r) in zip(given, picked, strict=True)):
        given[max(range(len(given)), key=lambda i: len(picked[i][1]) - given[i])] += 1
    while sum(given) > wanted and any(g > 1 for g in given):
        given[max(range(len(given)), key=lambda i: given[i])] -= 1
    out = []
    for (moment, run), share_ in zip(picked, given, strict=True):
        if share_ >= len(run):
            out += run
            continue
        for k, here in enumerate(stretches(run, share_)):
            if k in (0, share_ - 1):
                out.append(here[0 if k == 0 else -1])
            else:
                out.append(max(here, key=worth) if drawn(seed, book, moment, k) < 0.6 else min(here, key=lambda s: (drawn(seed, book, s["id"]), s["id"])))
    out[0], out[-1] = kept[0], kept[-1]
    return {s["id"] for s in out}


@pytest.mark.parametrize("share,most,seed", [(0.4, 120, 7), (0.9, 60, 1), (0.05, 120, 2)])
def test_a_book_is_chosen_in_moments(spark, share, most, seed):
    albums = [album(1, 150), album(2, 40), album(3, 5), album(4, 90)]
    got = {}
    for r in books.chosen(frame(spark, *albums), share, most, seed).collect():
        got.setdefault(r["book"], []).append(r["id"])
    want = {a[0]["book"]: chosen(a, share, most, seed) for a in albums}
    assert {b: set(x) for b, x in got.items()} == want and all(len(x) == len(set(x)) for x in got.values())


def test_undated_shots_go_where_they_look_like_the_others(spark):
    albums = [album(s, n) for s, n in ((1, 80), (2, 12), (3, 6))]
    for a in albums:
        for i, r in enumerate(a):
            r["guessed"] = True if a[0]["book"] == 3 or i % 5 == 0 else None
    want = {}
    for a in albums:
        runs = runs_of([r for r in a if not r["guessed"]])
        for r in a:
            tags = lambda s: set(s["tags"] or []) - {None, ""}
            like = lambda x, y: len(tags(x) & tags(y)) / len(tags(x) | tags(y)) if tags(x) and tags(y) else 0.0
            want[r["book"], r["id"]] = max(runs, key=lambda run: max(like(r, o) for o in run))[-1]["taken_at"] if r["guessed"] and runs else r["taken_at"]  # noqa: B023
    got = books.placed(frame(spark, *albums))
    assert {(r["book"], r["id"]): r["taken_at"] for r in got.collect()} == want and got.count() == len(want)


def paged(shots):
    out = [("auftakt", [])]
    day = None
    for run in runs_of(shots):
        if run[0]["taken_at"].date() != day:
            day = run[0]["taken_at"].date()
            out.append(("tag", []))
        read = [s for s in run if len(s["ocr"] or "") > 25]
        if read:
            find = max(read, key=lambda s: len(s["ocr"]))
            out.append(("fundstueck", [find["id"]]))
            run = [s for s in run if s is not find]
        if len(run) >= 5 and any(s["latitude"] for s in run):
            out.append(("karte", [s["id"] for s in run[:3]]))
            run = run[3:]
        for i in range(0, len(run), 3):
            p = run[i : i + 3]
            kind = "doppelseite" if len(p) == 1 and p[0]["width"] > p[0]["height"] else "streifen" if len(p) == 3 else "zwei"
            out.append((kind, [s["id"] for s in p]))
    return [*out, ("schluss", [])]


def test_pages(spark):
    albums = [album(1, 120), album(2, 3), album(5, 60)]
    got = {}
    for r in books.pages(frame(spark, *albums)).orderBy("book", "page").collect():
        got.setdefault(r["book"], []).append((r["kind"], r["shots"]))
        assert r["page"] == len(got[r["book"]])
    assert got == {a[0]["book"]: paged(a) for a in albums} and len({k for k, _ in got[1]}) == 8


def test_books_of_nothing(spark):
    none = frame(spark, album(1, 2)).limit(0)
    assert all(f(none).count() == 0 for f in (books.placed, books.chosen, books.pages))
    one = frame(spark, album(1, 1)).where(F.col("book") == 1)
    assert books.chosen(one).count() == 1 and books.pages(one).count() == 4


def test_placing_looks_at_a_set_of_tags_once(spark, monkeypatch):
    from lumenlake.operators import books as B

    rows = [(1, i, dt.datetime(2024, 5, 1) + dt.timedelta(hours=2 * i), False, ["a", "b"]) for i in range(200)]  # each a moment
    rows += [(1, 1000 + i, dt.datetime(2024, 1, 1), True, ["b", "a", "a"]) for i in range(200)] + [(1, 2000 + i, dt.datetime(2024, 1, 1), True, ["b"]) for i in range(200)]
    rows += [(1, 3000, dt.datetime(2024, 1, 1), True, ["c"])]
    counts, real = [], B.written
    monkeypatch.setattr(B, "written", lambda df: (counts.append((t := real(df)).count()), t)[1])
    got = B.placed(spark.createDataFrame(rows, "book long, id long, taken_at timestamp, guessed boolean, tags array<string>")).collect()
    assert {r["taken_at"] for r in got if r["guessed"]} == {dt.datetime(2024, 5, 1)} and len(got) == 601
    assert counts == [601, 200, 1, 2]  # one set of dated shots; of the others only those that no dated shot has
