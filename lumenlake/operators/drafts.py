"""What is wrong with written pages of a book: fourteen weighted rules over each draft, and the best draft of a page.

A draft is a row of book, page, draft, headline, story, lines (one for each captioned picture), names (of the persons known to be
there), used (headlines of other pages) and wanted (the number of lines a page needs). Everything is told from a row by itself, so
drafts of any number are judged where they lie. Null texts, arrays and names are empty; a draft without a headline or a story has
that one fault. Ties between drafts go to the smaller draft; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.picks import first_of

# The words that each rule looks for in lower-cased text.
COUNTED = [
    "zwei jungen", "drei jungen", "vier jungen", "zwei männer", "drei männer", "zwei frauen", "zwei kinder", "drei kinder", "vier kinder", "zwei personen", "drei personen", "mehrere personen",
    "die jungen", "die männer", "die frauen", "die kinder", "die gruppe", "eine gruppe", "der gruppe", "die familie", "familie im", "jemand", "eine person", "die person", "der junge", "ein junge",
    "der mann", "ein mann", "die erwachsenen", "ein mensch", "mensch mit", "die leute", "eine frau", "die frau", "kinder", "erwachsene", "zwei andere",
]
NUMBERS = ["zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "mehrere", "einige"]
PEOPLE = ["männer", "frauen", "jungen", "jungs", "mädchen", "kinder", "personen", "leute", "erwachsene", "menschen", "gäste", "andere", "weitere"]
COUNTING = ["zwei ", "drei ", "vier ", "fünf ", "sechs ", "sieben ", "acht ", "mehrere ", "ein moment", "eine aufnahme", "ein bild"]
POSING = ["blickt", "blick aus", "schaut", "guckt", "posiert", "zeigt sich", "reflexion", "spiegelung", "nahaufnahme", "aufnahme von", "abgebildet", "im vordergrund", "im hintergrund", "befindet sich"]
FELT = ["magisch", "unvergess", "abenteuer", "erinnerungen fürs", "traumhaft", "idyllisch", "unbeschreiblich", "für die ewigkeit", "!"]
JARGON = ["abschnitt", "station", "reisegruppe", "tageszeit", "transfer", "rücktransport", "etappe", "aufenthalt", "fakten", "bildzeile", "beschreibung"]
UNKNOWN = ["landung", "gelandet", "abgeflogen", "beim start der maschine", "im steigflug"]
HEDGING = ["vermutlich", "wahrscheinlich", "vielleicht", "womöglich"]

# What each fault costs, and the most words of a headline and of a line.
COSTS = {"missing": 99, "counted": 6, "counting": 4, "posing_headline": 4, "posing_text": 2, "nameless": 4, "felt": 5, "jargon": 4, "unknown": 5, "hedging": 6, "long_headline": 2, "used": 3, "line_number": 4, "long_line": 2}
HEADLINE_WORDS, LINE_WORDS = 7, 9


def has(text: Column, words: list[str]) -> Column:
    """Whether any of the words is anywhere in the text."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def people_numbered(text: Column) -> Column:
    """Whether a number stands right before a word for people, both as whole words. Only texts with such a word are matched."""
    edge = r"[\p{L}\p{N}_]"
    return has(text, PEOPLE) & F.rlike(text, F.lit(rf"(?<!{edge})(?:{'|'.join(NUMBERS)}|\d+)\s+(?:{'|'.join(PEOPLE)})(?!{edge})"))


def words_above(text: Column, most: int) -> Column:
    """Whether a text has more than `most` words, told at the word after those, in one pass."""
    return F.rlike(text, F.lit(rf"^\s*+\S++(?:\s++\S++){{{most}}}"))


def bare(text: Column) -> Column:
    """A text without white space at its ends; null is empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))


def _prepared(drafts: DataFrame) -> DataFrame:
    """drafts with what the rules look at. The columns are made one step after the other, as each is used by many rules: within
    one expression each rule would trim, join and lower the whole texts anew for each of its words."""
    texts = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    out = drafts.withColumns({"_headline": bare(F.col("headline")), "_story": bare(F.col("story")), "_lines": texts("lines"), "_names": F.filter(texts("names"), lambda x: x != ""), "_used": texts("used")})
    return out.withColumns({"_all": F.lower(F.array_join(F.concat(F.array("_headline", "_story"), "_lines"), " ")), "_text": F.lower(F.array_join(F.concat(F.array("_story"), "_lines"), " ")), "_title": F.lower("_headline")})


def _rules() -> dict[str, Column]:
    """Whether a prepared draft has each fault but the missing text."""
    everything, text, title, lines = (F.col(c) for c in ("_all", "_text", "_title", "_lines"))
    start = max(map(len, COUNTING))  # lower-casing leaves no letter out, so a line's beginning tells how its lower-cased form begins
    wanted = F.coalesce(F.col("wanted"), F.lit(0))
    return {
        "counted": has(everything, COUNTED) | people_numbered(everything),
        "counting": F.exists(F.concat(F.array("_headline"), lines), lambda x: F.lower(F.substring(x, 1, start)).rlike("^(" + "|".join(COUNTING) + ")")),
        "posing_headline": has(title, POSING),
        "posing_text": has(text, POSING),
        "nameless": (F.size("_names") > 0) & ~F.exists("_names", lambda n: F.contains(everything, F.lower(n))),
        "felt": has(everything, FELT),
        "jargon": has(everything, JARGON),
        "unknown": has(everything, UNKNOWN),
        "hedging": has(everything, HEDGING),
        "long_headline": words_above(F.col("_headline"), HEADLINE_WORDS),
        "used": F.exists("_used", lambda u: F.lower(u) == title),
        "line_number": (wanted > 0) & (F.size(lines) != wanted),
        "long_line": F.exists(lines, lambda x: words_above(x, LINE_WORDS)),
    }


def faulted(drafts: DataFrame) -> DataFrame:
    """drafts with faults: the names of a draft's faults, in the order of COSTS."""
    rules = _rules()
    looked = _prepared(drafts).select(*drafts.columns, ((F.col("_headline") == "") | (F.col("_story") == "")).alias("_missing"), *(r.alias(f"_is_{n}") for n, r in rules.items()))
    found = F.array_compact(F.array(*(F.when(F.col(f"_is_{n}"), n) for n in COSTS if n != "missing")))
    return looked.select(*drafts.columns, F.when(F.col("_missing"), F.array(F.lit("missing"))).otherwise(found).alias("faults"))


def cost(names: Column) -> Column:
    """What the named faults cost together."""
    costs = F.create_map(*(x for n, c in COSTS.items() for x in (F.lit(n), F.lit(c))))
    return F.aggregate(names, F.lit(0), lambda a, n: a + costs[n])


def judged(drafts: DataFrame) -> DataFrame:
    """drafts with faults, cost and worst (the fault that costs most, of equals the first; null without any)."""
    out = faulted(drafts.drop("faults"))
    dearest = F.array_sort(F.transform("faults", lambda n, i: F.struct((-cost(F.array(n))).alias("c"), i.alias("i"), n.alias("n"))))
    return out.withColumn("cost", cost(F.col("faults"))).withColumn("worst", F.try_element_at(dearest, F.lit(1))["n"])


def best(drafts: DataFrame) -> DataFrame:
    """Of each page's judged drafts the one that costs least."""
    return first_of(judged(drafts).where("book is not null and page is not null"), ["book", "page"], [F.col("cost"), F.col("draft")], 1).drop("place")
