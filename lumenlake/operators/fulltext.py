"""Search by words: search-box phrases over weighted sources, word likeness of names, fusion of lists, what a query means.

Words are runs of a-z and 0-9 in lower case. Null texts have no word. Ties go to the smallest key; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators import search

# Words for kinds and months in a query, and words that join.
KINDS = {"photo": "image", "photos": "image", "foto": "image", "fotos": "image", "video": "video", "videos": "video", "film": "video"}
MONTHS = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]
SHORT = {"jan": 1, "feb": 2, "maerz": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "okt": 10, "nov": 11, "dez": 12}
SEASONS = {"frühling": (3, 6), "fruehling": (3, 6), "frühjahr": (3, 6), "sommer": (6, 9), "herbst": (9, 12), "winter": (12, 15)}
JOINING = ["und", "mit", "in", "im", "aus", "von", "bei", "&"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _terms(phrase: str) -> list[list[tuple[bool, str]]]:
    """Alternatives (parted by OR) of terms: (whether it must be missing, its words parted by blanks)."""
    out: list[list[tuple[bool, str]]] = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', phrase):
        words = " ".join(re.findall("[a-z0-9]+", (quoted or plain).lower()))
        if plain.lower() == "or" and not minus:
            out.append([])
        elif words:
            out[-1].append((bool(minus), words))
    return [x for x in out if x]


def _count(padded: Column, words: str) -> Column:
    """Times that words follow one another; padded holds each word between blanks of its own."""
    needle = "  ".join(words.split(" "))
    return F.floor((F.length(padded) - F.length(F.replace(padded, F.lit(f" {needle} "), F.lit("")))) / (len(needle) + 2))


def matches(text: Column, phrase: str) -> tuple[Column, Column]:
    """(whether a text fits, how often the wanted terms are in it): all terms of an alternative, none of those with a minus;
    quotes ask for words in a row. A phrase without a word fits nothing."""
    padded = F.concat(F.lit(" "), F.array_join(words_of(text), "  "), F.lit(" "))
    fits, hits = F.lit(False), F.lit(0)
    for alternative in _terms(phrase):
        one = F.lit(True)
        for missing, words in alternative:
            n = _count(padded, words)
            one = one & ((n == 0) if missing else (n > 0))
            hits = hits if missing else hits + n
        fits = fits | one
    return F.coalesce(fits, F.lit(False)), F.coalesce(hits, F.lit(0))


def found_in(sources: list[tuple[float, DataFrame]], phrase: str, most: int = 200) -> DataFrame:
    """key, moment, score, rank over sources of (weight, table of key, moment, text): the best row of each key, by weight times
    ln(1 + hits), then the earliest moment (none last); the `most` best keys in order. One shuffle by key."""
    parts = []
    for weight, rows in sources:
        fits, hits = matches(F.col("text"), phrase)
        parts.append(rows.where(fits).select(F.col("key").cast("long").alias("key"), F.col("moment").cast("long").alias("moment"), F.round(F.lit(weight) * F.log1p(hits.cast("double")), 6).alias("score")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    late = F.coalesce("moment", F.lit((1 << 62)))
    best = both.groupBy("key").agg(F.max("score").alias("score"), F.min_by("moment", F.struct(-F.col("score"), late)).alias("moment"))
    top = best.orderBy(F.desc("score"), "key").limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "key")))  # over the bounded list alone


def word_likeness(query: str, name: Column) -> Column:
    """The share of the query's trigrams that a name's words have; null for a null name, 0 where the query has none."""
    q = search.trigrams(F.lit(query))
    return F.when(name.isNotNull(), F.coalesce(F.size(F.array_intersect(q, search.trigrams(name))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)))


def names(rows: DataFrame, key: str, columns: list[str], query: str, least: float = 0.5, most: int = 200) -> DataFrame:
    """key, likeness of the keys whose best name in any row and column is like the query; the `most` best."""
    like = F.greatest(*(F.coalesce(word_likeness(query, F.col(c)), F.lit(0.0)) for c in columns)) if len(columns) > 1 else F.coalesce(word_likeness(query, F.col(columns[0])), F.lit(0.0))
    best = rows.select(key, F.round(like, 6).alias("likeness")).where(F.col("likeness") >= least).groupBy(key).agg(F.max("likeness").alias("likeness"))
    return best.orderBy(F.desc("likeness"), key).limit(most)


def fused(lists: dict[str, DataFrame], described: DataFrame, k: int = 60, sure: int = 20) -> DataFrame:
    """key, score, moment: ranked lists (key, rank, moment) under one; moment: that of the smallest rank that has one.

    A key that only the list 'picture' has stays if it is not among `described` and its rank there is `sure` or better."""
    parts = [df.select("key", F.col("rank").cast("long").alias("rank"), F.col("moment").cast("long").alias("moment"), F.lit(name).alias("list")) for name, df in lists.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    score = F.round(F.sum(1.0 / (k + F.col("rank"))), 9)
    moment = F.min_by("moment", F.when(F.col("moment").isNotNull(), F.struct("rank", "moment")))
    each = both.groupBy("key").agg(score.alias("score"), moment.alias("moment"), F.bool_and(F.col("list") == "picture").alias("_alone"), F.min("rank").alias("_rank"))
    told = each.join(described.select("key", F.lit(True).alias("_told")).distinct(), "key", "left")
    return told.where(~F.col("_alone") | (F.col("_told").isNull() & (F.col("_rank") <= sure))).select("key", "score", "moment")


@dataclass
class Understood:
    """What a query asks for: words left to search, days [since, until), kind, names."""

    rest: str
    since: str | None = None
    until: str | None = None
    kind: str | None = None
    names: list[str] = field(default_factory=list)


def understood(query: str, known: DataFrame | None = None, name: str = "name") -> Understood:
    """Years ('2019', '2019-2021', '2019 bis 2021'), months and seasons with a year (winter reaches into the next), a kind, and names of up to three words out of a table, the
    longest first from left to right; joining words that are left at an end go. Only names that hold a word of the query
    are read from the table, no more than the query has runs of words."""
    words = re.sub(r"(?<!\S)(\d{4})\s*(?:-|–|\sbis\s)\s*(\d{4})(?!\S)", r"\1-\2", query).split()
    runs = [" ".join(words[i : i + n]).lower() for n in (3, 2, 1) for i in range(len(words) - n + 1)]
    hits = {r[0] for r in known.where(F.lower(F.col(name)).isin(runs)).select(F.lower(F.col(name))).distinct().collect()} if known is not None and runs else set()
    out, rest, i = Understood(""), [], 0
    while i < len(words):
        n = next((n for n in (3, 2, 1) if i + n <= len(words) and " ".join(words[i : i + n]).lower() in hits), 0)
        if n:
            out.names.append(" ".join(words[i : i + n]).lower())
            i += n
            continue
        w = words[i].lower()
        year = re.fullmatch(r"((?:19|20)\d\d)(?:-((?:19|20)\d\d))?", w)
        if year and not out.since:
            a, z, first, last = int(year[1]), int(year[2] or year[1]), 1, 13
            part = rest[-1].lower() if rest and not year[2] else ""
            if part in MONTHS or part in SHORT or part in SEASONS:
                rest.pop()
                month = SHORT.get(part) or (MONTHS.index(part) + 1 if part in MONTHS else 0)
                first, last = SEASONS.get(part) or (month, month + 1)
            out.since, out.until = f"{min(a, z)}-{first:02d}-01", f"{max(a, z) + (last - 1) // 12}-{(last - 1) % 12 + 1:02d}-01"
        elif w in KINDS and not out.kind:
            out.kind = KINDS[w]
        else:
            rest.append(words[i])
        i += 1
    while rest and rest[-1].lower() in JOINING:
        rest.pop()
    while rest and rest[0].lower() in JOINING:
        rest.pop(0)
    out.rest = " ".join(rest)
    return out


def find(query: str, sources: list[tuple[float, DataFrame]], media: DataFrame, pictures: DataFrame, probe: list[float], people: DataFrame, most: int = 200, bound: float = 0.92) -> tuple[Understood, DataFrame]:
    """(what was understood, hits): key, score, moment of the media that fit. media: key, at, kind, person, name; pictures: key,
    vector; people: name. Lists of words, pictures and names are fused; each is cut to what the filters let through before it
    is cut to `most`. Without words left it is a walk: all that fit, scored 0."""
    said = understood(query, people)
    keep = media
    if said.since:
        keep = keep.where((F.col("at") >= F.lit(said.since).cast("timestamp")) & (F.col("at") < F.lit(said.until).cast("timestamp")))
    if said.kind:
        keep = keep.where(F.col("kind") == said.kind)
    if said.names:  # all of them in one medium, which has a row for each
        keep = keep.join(search.all_of(keep.select("key", F.lower("person").alias("_who")), "key", "_who", sorted(set(said.names))), "key", "left_semi")
    if not said.rest:
        return said, keep.select("key", F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("moment")).distinct()
    keys = keep.select("key").distinct()
    words = found_in([(w, s.join(keys, "key", "left_semi")) for w, s in sources], said.rest, most)
    near = search.nearest(pictures.join(keys, "key", "left_semi"), "key", "vector", probe, most)
    near = near.where(F.col("distance") <= bound).withColumn("rank", F.row_number().over(W.orderBy("distance", "key")))
    called = names(keep, "key", ["name"], said.rest, most=most).withColumn("rank", F.row_number().over(W.orderBy(F.desc("likeness"), "key")))
    none = F.lit(None).cast("long").alias("moment")
    return said, fused({"words": words, "picture": near.select("key", "rank", none), "names": called.select("key", "rank", none)}, sources[0][1].where("text is not null"))
