"""A whole search: what a query means, filters over media, lists under one rank, pages and facets.

A medium is shown if it is active and no copy of another. Null conditions of a filter ask for nothing; media without the value
that a filter asks for do not fit. Equal scores are ordered by key; an empty library gives no hits.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators import fulltext, gazetteer, postings, search, trigrams
from lumenlake.operators.groups import written

# Words of a query, how many hits a list and a walk give, how near a picture is, values of a facet.
MONTHS = {
    "januar": 1, "jan": 1, "februar": 2, "feb": 2, "märz": 3, "maerz": 3, "april": 4, "apr": 4, "mai": 5, "juni": 6, "jun": 6, "juli": 7, "jul": 7, "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9, "oktober": 10, "okt": 10, "november": 11, "nov": 11, "dezember": 12, "dez": 12,
}
SEASONS = {"frühling": (3, 5), "fruehling": (3, 5), "frühjahr": (3, 5), "sommer": (6, 8), "herbst": (9, 11), "winter": (12, 14)}
KINDS = {"video": "video", "videos": "video", "film": "video", "filme": "video", "foto": "image", "fotos": "image", "bild": "image", "bilder": "image"}
FILLERS = ("aus", "von", "im", "in", "am", "nur", "mit")
JOINING = ("und", "mit", "&")
LISTED, WALKED, NEAR, FACETED = 200, 800, 0.92, 40


@dataclass(frozen=True)
class Asked:
    """What a query asks for: the words that are left, the first day and the first that no longer counts, a kind, the persons and
    places as typed with their numbers and keys."""

    text: str
    since: str | None = None
    until: str | None = None
    kind: str | None = None
    names: tuple[str, ...] = ()
    persons: tuple[int, ...] = ()
    places: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()


def _year(word: str) -> int | None:
    return int(word) if re.fullmatch(r"\d{4}", word, re.ASCII) and 1950 <= int(word) < 2100 else None


def _day(year: int, month: int) -> str:
    """The first of a month; months beyond the twelfth are those of the next year."""
    return f"{year + (month - 1) // 12}-{(month - 1) % 12 + 1:02d}-01"


def parsed(query: str) -> Asked:
    """Period and kind of a query. A range of years ('2018-2020', with blanks, a dash or 'bis') comes before a month or season with
    a year (winter reaches into the next), and that before a year alone; words that lead to them go with them."""
    words = re.sub(r"(?<!\S)(\d{4})[-–](\d{4})(?!\S)", r"\1 - \2", " ".join(query.split())).split()
    low = [w.lower().strip(",.") for w in words]
    years = [_year(w) for w in low]
    since = until = kind = None
    cut: tuple[int, int] | None = None
    for i in range(len(words) - 2):
        if years[i] and years[i + 2] and low[i + 1] in ("-", "–", "bis"):
            a, z = sorted((years[i], years[i + 2]))
            since, until, cut = _day(a, 1), _day(z + 1, 1), (i, i + 3)
            break
    if cut is None:
        for i in range(len(words) - 1):
            span = SEASONS.get(low[i]) or (MONTHS.get(low[i]),) * 2
            if span[0] and years[i + 1]:
                since, until = _day(years[i + 1], span[0]), _day(years[i + 1], span[1] + 1)
                cut = (i - (i > 0 and low[i - 1] in ("im", "in")), i + 2)
                break
    if cut is None and any(years):
        i = next(i for i, y in enumerate(years) if y)
        lead = 2 if i > 1 and low[i - 2 : i] == ["im", "jahr"] else int(i > 0 and low[i - 1] in ("aus", "von", "in"))
        since, until, cut = _day(years[i], 1), _day(years[i] + 1, 1), (i - lead, i + 1)
    if cut:
        words, low = words[: cut[0]] + words[cut[1] :], low[: cut[0]] + low[cut[1] :]
    at = next((i for i, w in enumerate(low) if w in KINDS), None)
    if at is not None:
        kind, first = KINDS[low[at]], at - (at > 0 and low[at - 1] == "nur")
        words = words[:first] + words[at + 1 :]
    if words and words[-1].lower() in FILLERS:
        words.pop()
    return Asked(" ".join(words).strip(" ,.-"), since, until, kind)


def persons_in(words: str, people: DataFrame) -> tuple[str, list[str], list[int]]:
    """(what is left of a query, the persons named in it as typed, their numbers). people: person, name, hidden; hidden ones are
    nobody to search for, of equal names the smallest number counts. Names of up to three words, the longest first from left to
    right; a joining word before one goes with it."""
    found = [(m.start(), m.start() + len(m[0].rstrip("'.-"))) for m in re.finditer(r"[^\W\d_][\w'.-]*", words)]
    run = lambda i, n: " ".join(words[a:z] for a, z in found[i : i + n]).lower()
    runs = {run(i, n) for n in (1, 2, 3) for i in range(len(found) - n + 1)}
    if not runs:
        return words, [], []
    shown = people.where(~F.coalesce(F.col("hidden"), F.lit(False)) & F.lower("name").isin(sorted(runs)))
    known = {r["n"]: r["p"] for r in shown.groupBy(F.lower("name").alias("n")).agg(F.min("person").alias("p")).collect()}  # at most one a run
    spans, ids, i = [], [], 0
    while i < len(found):
        n = next((n for n in (3, 2, 1) if i + n <= len(found) and run(i, n) in known), 0)
        if n:
            spans.append((found[i][0], found[i + n - 1][1]))
            ids.append(known[run(i, n)])
        i += n or 1
    return *gazetteer.without(words, spans, JOINING), list(dict.fromkeys(ids))


@dataclass(frozen=True)
class Filters:
    since: str | None = None
    until: str | None = None
    kind: str | None = None
    album: str | None = None
    camera: str | None = None
    keys: tuple[str, ...] = ()
    persons: tuple[int, ...] = ()


@dataclass
class Library:
    """media: key, taken_at, kind, album, make, model, place, status, copy_of; places: id, name, country, keys; faces: medium,
    person; people: person, name, hidden; pictures: key, vector; described: key; words and names: the indexes of texts and names."""

    media: DataFrame
    places: DataFrame
    faces: DataFrame
    people: DataFrame
    pictures: DataFrame
    described: DataFrame
    words: DataFrame
    names: trigrams.Names
    weights: dict[str, float] = field(default_factory=dict)


def shown(media: DataFrame) -> DataFrame:
    """The media that anything shows."""
    return media.where((F.col("status") == "active") & F.col("copy_of").isNull())


def camera(make: Column, model: Column) -> Column:
    """A camera's name: make and model; null without a model."""
    return F.trim(F.concat(F.coalesce(make, F.lit("")), F.lit(" "), model))


def filtered(library: Library, f: Filters) -> DataFrame:
    """The shown media that fit all filters: the time from since to before until, kind, album (itself or below), camera, a place that
    has one of the keys, and all of the persons."""
    m = shown(library.media)
    if f.since:
        m = m.where(F.col("taken_at") >= F.lit(f.since).cast("timestamp"))
    if f.until:
        m = m.where(F.col("taken_at") < F.lit(f.until).cast("timestamp"))
    if f.kind:
        m = m.where(F.col("kind") == f.kind)
    if f.album is not None:
        m = m.where((F.col("album") == f.album) | F.col("album").startswith(f"{f.album}/"))
    if f.camera is not None:
        m = m.where(camera(F.col("make"), F.col("model")) == f.camera)
    if f.keys:
        there = library.places.where(F.arrays_overlap("keys", F.array(*(F.lit(k) for k in f.keys)))).select(F.col("id").alias("place"))
        m = m.join(there, "place", "left_semi")
    if f.persons:
        m = m.join(search.all_of(library.faces, "medium", "person", f.persons).select(F.col("medium").alias("key")), "key", "left_semi")
    return m


@dataclass
class Found:
    asked: Asked
    hits: DataFrame
    page: DataFrame
    following: int | None
    facets: DataFrame


def hits(library: Library, words: str, f: Filters, probe: Sequence[float] | None) -> DataFrame:
    """key, score, moment, place of what fits: lists of words, pictures and names under one rank; without words a walk through the
    filtered media, the newest first, WALKED of them at most, scored 0."""
    keep = filtered(library, f)
    if not words:
        walk = keep.select("key", "taken_at").distinct().orderBy(F.desc_nulls_last("taken_at"), "key").limit(WALKED)
        return walk.select("key", F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("moment"), F.row_number().over(W.orderBy(F.desc_nulls_last("taken_at"), "key")).alias("place"))  # over the bounded list alone
    keys = written(keep.select("key").distinct())
    none = F.lit(None).cast("double").alias("moment")
    lists = {"words": postings.search(library.words, words, library.weights, LISTED, keys=keys).select("key", "rank", "moment")}
    if probe is not None:
        near = search.nearest(library.pictures.join(keys, "key", "left_semi"), "key", "vector", probe, LISTED)
        lists["picture"] = near.where(F.col("distance") <= NEAR).select("key", F.row_number().over(W.orderBy("distance", "key")).alias("rank"), none)
    called = trigrams.alike(library.names, words, most=None).join(keys, "key", "left_semi").orderBy(F.desc("likeness"), "key").limit(LISTED)
    lists["names"] = called.select("key", F.row_number().over(W.orderBy(F.desc("likeness"), "key")).alias("rank"), none)
    best = fulltext.fused(lists, library.described)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "key")))  # three lists of LISTED


def facets(library: Library, found: DataFrame, most: int = FACETED) -> DataFrame:
    """facet, value, label, n of years, cameras, towns and albums among the hits, the `most` frequent of each. One pass over the hits'
    media: places are joined by number."""
    towns = library.places.select(F.col("id").alias("place"), F.col("name").alias("town"), F.coalesce("country", F.lit("")).alias("land"))
    m = library.media.join(found.select("key").distinct(), "key", "left_semi").join(towns, "place", "left")
    year, cam = F.year("taken_at").cast("string"), camera(F.col("make"), F.col("model"))
    one = lambda name, value, label: F.struct(F.lit(name).alias("facet"), value.alias("value"), label.alias("label"))
    town = F.concat_ws(", ", "town", F.nullif("land", F.lit("")))
    each = F.array(one("year", year, year), one("camera", cam, cam), one("town", F.col("town"), F.when(F.col("town").isNotNull(), town)), one("album", F.col("album"), F.col("album")))
    n = m.select(F.explode(each).alias("f")).select("f.*").where("value is not null").groupBy("facet", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value", "label"))
    return n.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def find(library: Library, query: str, filters: Filters | None = None, probe: Sequence[float] | None = None, by_date: bool = False, offset: int = 0, limit: int = 60) -> Found:
    """A search from the words typed to one page: persons are taken out of the query, then places, and both narrow what the filters
    ask for; a period or kind of the filters comes before that of the query. by_date orders the hits newest first."""
    f = filters or Filters()
    said = parsed(query)
    text, names, ids = persons_in(said.text, library.people)
    text, places, keys = gazetteer.places_in(text, library.places, shown(library.media).where("place is not null"))
    said = replace(said, text=text, names=tuple(names), persons=tuple(ids), places=tuple(places), keys=tuple(keys))
    merged = replace(f, since=f.since or said.since, until=f.until or said.until, kind=f.kind or said.kind, keys=tuple(dict.fromkeys((*f.keys, *keys))), persons=tuple(dict.fromkeys((*f.persons, *ids))))
    found = written(hits(library, text, merged, probe))
    if by_date and text:
        at = library.media.select("key", "taken_at").dropDuplicates(["key"])
        found = written(found.join(at, "key").withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("taken_at"), "key"))).drop("taken_at"))  # of hits alone
    page = found.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).orderBy("place")
    more = found.where(F.col("place") > offset + limit).limit(1).count()
    return Found(said, found, page, offset + limit if more else None, facets(library, found))
