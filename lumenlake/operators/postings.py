"""A full-text index by words: postings with places and labels, written in the order of their terms, so that a search reads those
of its own words and no text.

A text row has a source, a key, a moment, whether it is German (its words are stemmed and common ones left out; others are taken
word for word), and fields of a label (A counts most, D least), a text, and for speech the second at which it starts. Words
are runs of letters and digits in small letters; their places count on through the fields of a row. Null texts have no word,
null labels count as D. Rows that repeat are found each, but a key comes up once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators import stems
from lumenlake.operators.groups import written

# What an occurrence counts under each label, and the limit of 1 + 1/4 + 1/9 and so on.
COUNTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
LIMIT = 1.64493406685
FIELDS = "array<struct<label:string,text:string,start:double>>"
_GAP = r"[^\p{L}\p{N}]+"
#: Bytes of text that are worked on together, and the shares of its rows that a term is dealt to.
BLOCK, SPREAD = 1_000_000, 64
_INDEX = "term string, id bigint, source string, key bigint, moment double, german boolean, length int, places array<int>, counts array<double>, spans array<struct<first:int,start:double>>"


def field(label: str, text: Column, start: Column | None = None) -> Column:
    """One entry of fields."""
    return F.struct(F.lit(label).alias("label"), text.cast("string").alias("text"), (F.lit(None) if start is None else start).cast("double").alias("start"))


_stem = lru_cache(1 << 16)(stems.german)


def _lexemes(words: list[str], german: bool) -> list[str | None]:
    return [None if w in stems.STOP else _stem(w) for w in words] if german else list(words)


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about BLOCK bytes of text, a row at least: what a task holds follows the longest row."""
    per_row = pc.list_value_length(b.column("texts")).to_numpy(zero_copy_only=False)
    size = np.concatenate([[0], np.cumsum(pc.binary_length(b.column("texts").flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)])
    before = size[np.cumsum(per_row) - per_row]
    edges = [0, *(np.flatnonzero(np.diff(before // BLOCK)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if lo < hi:
            yield b.slice(lo, hi - lo)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has."""
    parts = pc.split_pattern_regex(texts, _GAP)
    full = pc.not_equal(parts.flatten(), "")
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return parts.flatten().filter(full), np.diff(before[bounds])


def _analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts as a row for each distinct term, and one without a term that tells of the text as a whole."""
    for b in (part for whole in batches for part in _blocks(whole)):
        per_row = pc.list_value_length(b.column("texts")).to_numpy(zero_copy_only=False)
        words, per_field = _words(b.column("texts").flatten())
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row_of_field = np.repeat(np.arange(b.num_rows), per_row)
        row = np.repeat(row_of_field, per_field)
        counts = np.repeat(b.column("counts").flatten().to_numpy(zero_copy_only=False), per_field)
        starts = np.searchsorted(row, np.arange(b.num_rows))
        place = np.arange(len(row)) - starts[row] + 1
        german = b.column("german").to_numpy(zero_copy_only=False).astype(bool)
        number, term = coded.dictionary, code
        if german.any():
            vocabulary = number.to_pylist()
            known = {t: i for i, t in enumerate(vocabulary)}
            used = np.unique(code[german[row]])
            stemmed = np.arange(len(vocabulary))
            stemmed[used] = [-1 if t is None else known.setdefault(t, len(known)) for t in _lexemes([vocabulary[c] for c in used.tolist()], True)]
            number, term = pa.array(list(known), pa.string()), np.where(german[row], stemmed[code], code)
        keep = np.flatnonzero(term >= 0)
        length = np.bincount(row[keep], minlength=b.num_rows).astype(np.int32)
        keep = keep[np.argsort(row[keep] * max(len(number), 1) + term[keep], kind="stable")]  # they are in the order of their places
        new = np.ones(len(keep), bool)
        new[1:] = (row[keep][1:] != row[keep][:-1]) | (term[keep][1:] != term[keep][:-1])
        bounds = np.append(np.flatnonzero(new), len(keep)).astype(np.int32)
        at = row[keep][new]
        terms = number.take(pa.array(term[keep][new]))
        about = [b.column(c) for c in ("id", "source", "key", "moment", "german")]
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[keep])) for x in (place.astype(np.int32), counts)]
        names = ["term", "id", "source", "key", "moment", "german", "length", "places", "counts", "spans"]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("start", pa.float64())]))
        yield pa.RecordBatch.from_arrays([terms, *(c.take(pa.array(at)) for c in about), pa.array(length[at]), *lists, pa.nulls(len(at), kind)], names)
        first = (np.cumsum(per_field) - per_field - starts[row_of_field] + 1).astype(np.int32) if len(row) else np.ones(len(row_of_field), np.int32)
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(first), b.column("starts").flatten()], ["first", "start"]))
        yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.string()), *about, pa.array(length), pa.nulls(b.num_rows, pa.list_(pa.int32())), pa.nulls(b.num_rows, pa.list_(pa.float64())), spans], names)


def build(texts: DataFrame) -> DataFrame:
    """The index of texts: source, key, moment, german, fields. It is dealt by term (and SPREAD shares of the rows, so that a word
    that most texts hold is not one part), sorted by term in each part, and written once. Each term of a text is a row; one row
    without a term tells the text's length."""
    one = lambda x: F.coalesce(*(F.when(x["label"] == k, F.lit(v)) for k, v in COUNTS.items()), F.lit(COUNTS["D"]))
    fields = F.coalesce(F.col("fields").cast(FIELDS), F.array().cast(FIELDS))
    rows = texts.select(
        F.monotonically_increasing_id().alias("id"), F.col("source").cast("string").alias("source"), F.col("key").cast("bigint").alias("key"), F.col("moment").cast("double").alias("moment"), F.coalesce(F.col("german"), F.lit(False)).alias("german"),
        F.transform(fields, lambda x: F.lower(F.coalesce(x["text"], F.lit("")))).alias("texts"), F.transform(fields, one).alias("counts"), F.transform(fields, lambda x: x["start"]).alias("starts"),
    )
    made = rows.where("key is not null").mapInArrow(_analysed, _INDEX)
    return written(made.repartition("term", F.pmod("id", F.lit(SPREAD))).sortWithinPartitions("term", "id"))


def parsed(phrase: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives (parted by OR) of terms: whether it must be missing, and its words, which follow one another."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', phrase):
        words = re.findall(r"[^\W_]+", (quoted or plain).lower())
        if plain.lower() == "or" and not minus:
            out.append([])
        elif words:
            out[-1].append((bool(minus), words))
    return [x for x in out if x]


def _fits(asked: list[list[tuple[bool, list[str]]]], german: bool, places: Callable[[str], Column]) -> Column:
    """Whether a text fits, by the places of its terms (null where it lacks one). Words that are left out ask for nothing, but the
    words beside them keep their distance."""
    fits = F.lit(False)
    for alternative in asked:
        every, used = F.lit(True), False
        for missing, words in alternative:
            at = [(t, i) for i, t in enumerate(_lexemes(words, german)) if t is not None]
            if not at:
                continue
            used = True
            (first, offset), rest = at[0], at[1:]
            if rest:
                has = F.coalesce(F.exists(places(first), _followed(places, rest, offset)), F.lit(False))
            else:
                has = places(first).isNotNull()
            every = every & (~has if missing else has)
        fits = fits | every if used else fits
    return fits


def _followed(places: Callable[[str], Column], rest: list[tuple[str, int]], offset: int) -> Callable[[Column], Column]:
    """Whether the other words of a phrase stand at their distances from a place of the first."""

    def check(p: Column) -> Column:
        out = F.lit(True)
        for t, i in rest:
            out = out & F.coalesce(F.array_contains(places(t), p + (i - offset)), F.lit(False))
        return out

    return check


def _weight(counts: Column) -> Column:
    """What the occurrences of one term weigh: the first of the heaviest in full, each other by the square of its place among
    them, over LIMIT; 0 without any."""
    top = F.array_max(counts)
    each = F.aggregate(F.zip_with(counts, F.sequence(F.lit(1), F.size(counts)), lambda c, i: c / (i * i)), F.lit(0.0), lambda s, x: s + x)
    at = F.array_position(counts, top)
    return F.coalesce(F.when(F.size(counts) > 0, (top + each - top / (at * at)) / LIMIT), F.lit(0.0))


def search(index: DataFrame, phrase: str, weights: dict[str, float], most: int = 200, by_length: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """key, moment, score, rank: the best text of each key among sources (weights; others are not searched), the `most` best keys.

    A text's score is its source's weight times the mean weight of the wanted terms, over 1 + ln(length) if by_length. The moment
    is the text's own, or the start of the first field that fits by itself; of equal scores the earliest counts, none last. keys:
    key of those that may come up. A phrase without a word that counts fits nothing."""
    asked = parsed(phrase)
    lexemes = {g: [t for a in asked for _, words in a for t in _lexemes(words, g) if t is not None] for g in (False, True)}
    wanted = {g: list(dict.fromkeys(t for a in asked for missing, words in a if not missing for t in _lexemes(words, g) if t is not None)) for g in (False, True)}
    terms = sorted({t for g in lexemes.values() for t in g})
    number = {t: i for i, t in enumerate(terms)}
    rows = index.where(F.col("source").isin(sorted(weights)))
    read = rows.where(F.col("term").isin(terms))
    if any(all(missing for missing, _ in a) for a in asked):  # what lacks a word has no posting of it
        read = read.unionByName(rows.where("term is null").withColumn("spans", F.lit(None).cast("array<struct<first:int,start:double>>")))
    if keys is not None:
        read = read.join(keys.select("key").distinct(), "key", "left_semi")
    of = lambda t, c: F.first(F.when(F.col("term") == t, F.col(c)), ignorenulls=True)
    about = [F.first(c).alias(c) for c in ("source", "key", "moment", "german", "length")]
    docs = read.groupBy("id").agg(*about, *(of(t, "places").alias(f"p{i}") for t, i in number.items()), *(of(t, "counts").alias(f"c{i}") for t, i in number.items()))
    both = lambda f: F.when(F.col("german"), f(True)).otherwise(f(False))
    docs = docs.where(both(lambda g: _fits(asked, g, lambda t: F.col(f"p{number[t]}"))))
    mean = lambda g: sum((_weight(F.col(f"c{number[t]}")) for t in wanted[g]), F.lit(0.0)) / max(len(wanted[g]), 1)
    of_source = F.coalesce(*(F.when(F.col("source") == s, F.lit(float(w))) for s, w in weights.items()))
    score = of_source * both(mean) / (1 + F.log(F.greatest("length", F.lit(1))) if by_length else F.lit(1.0))
    docs = docs.withColumn("score", F.round(score, 6))

    spoken = rows.where(F.col("term").isNull() & F.exists("spans", lambda x: x["start"].isNotNull())).select("id", "spans")
    heard = docs.where("moment is null").join(spoken, "id")
    each = heard.select("id", "german", *(f"p{i}" for i in number.values()), "length", F.explode(F.zip_with("spans", F.slice("spans", 2, F.size("spans")), lambda a, b: F.struct(a["first"].alias("lo"), b["first"].alias("hi"), a["start"].alias("start")))).alias("s"))
    within = lambda t: F.nullif(F.filter(f"p{number[t]}", lambda p: (p >= F.col("s.lo")) & (F.col("s.hi").isNull() | (p < F.col("s.hi")))), F.array().cast("array<int>"))
    first = each.where(F.col("s.start").isNotNull() & both(lambda g: _fits(asked, g, within))).groupBy("id").agg(F.min("s.start").alias("_start"))
    docs = docs.join(first, "id", "left").withColumn("moment", F.coalesce("moment", "_start"))
    late = F.coalesce("moment", F.lit(float("inf")))
    best = docs.groupBy("key").agg(F.max("score").alias("score"), F.min_by("moment", F.struct(-F.col("score"), late)).alias("moment"))
    top = best.orderBy(F.desc("score"), "key").limit(most)
    return top.select("key", "moment", "score", F.row_number().over(W.orderBy(F.desc("score"), "key")).alias("rank"))  # over the bounded list alone
