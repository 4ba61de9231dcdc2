"""What is known of a moment of a book, what a page says without a writer, and what is wrong with a written page.

A shot is a row of book, moment, id, taken_at, kind, caption, tags, scene, ocr, persons and suggested (arrays of names), place,
region, country, population. All moments are told at once, by aggregates within a moment that keep a fixed number of items
(captions, words, names); only tags and names of a moment meet as sets. Shots without a book, a moment, an id or a time are left
out, repeats of an id count once. Empty and null texts, tags and names are nothing. Ties go to the earlier shot, then to the smaller
id, names to the one seen first; an empty table gives no rows. Times are those of the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators.library import first_sentence, part_of_day
from lumenlake.operators.picks import first_of

# How many names, captions, words and lines are told; letters of a text worth reading, of a line, of a text cut whole.
NAMES, CAPTIONS, WORDS, LINES, LEGIBLE, LEAST_LINE, MOST_LINE, CUT = 3, 5, 10, 3, 25, 2, 46, 60

# What a moment is named after, by words among its tags and scenes; the first name that fits.
TOPICS = [
    ("Im Flugzeug", ["flugzeug", "flughafen", "kopfhörer"]),
    ("Am Grill", ["grill", "fleisch", "rauch", "kohle"]),
    ("Mit dem Roller", ["scooter", "roller", "elektro-scooter"]),
    ("Im Auto", ["auto", "rücksitz", "fahrzeug", "parkplatz"]),
    ("Bei Tisch", ["essen", "teller", "tisch", "restaurant", "frühstück", "glas"]),
    ("Am Wasser", ["reflexion", "spiegelung", "watt", "ufer"]),
    ("Am Strand", ["strand", "sand", "meer", "düne"]),
    ("Im Park", ["vogel", "vögel", "park", "bank", "möwe"]),
    ("Auf dem Spielplatz", ["klettergerüst", "spielplatz", "rutsche", "schaukel"]),
    ("In der Stadt", ["stadt", "straße", "fassade", "gebäude", "schild"]),
    ("Im Schnee", ["schnee", "winter", "eis", "schlitten"]),
    ("Am Wasser", ["see", "fluss", "boot", "hafen"]),
]

KEY = ["book", "moment"]


def some(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _set(items: str) -> Column:
    return F.filter(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def topic(words: Column, topics: list[tuple[str, list[str]]] = TOPICS) -> Column:
    """The first topic one of whose words is among `words`; '' without any."""
    named = F.lit("")
    for name, marks in reversed(topics):
        named = F.when(F.arrays_overlap(words, F.array(*map(F.lit, marks))), name).otherwise(named)
    return named


def clock(time: Column) -> Column:
    return F.date_format(time, "HH:mm")


def legible(ocr: Column) -> Column:
    """The lines of a text read off a thing that are neither too short nor too long, parted by line ends and slashes; where none is,
    the beginning of the text."""
    pieces = F.transform(F.split(ocr, "[\n/]"), lambda p: F.btrim(p, F.lit(" .,·")))
    kept = F.filter(pieces, lambda p: (F.length(p) > LEAST_LINE) & (F.length(p) < MOST_LINE))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.substring(ocr, 1, CUT)))


def where_it_is(region: Column, country: Column) -> Column:
    return F.array_join(F.filter(F.array(region, country), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")


def clean(shots: DataFrame) -> DataFrame:
    return shots.where("book is not null and moment is not null and id is not null and taken_at is not null").dropDuplicates(["book", "id"])


def _ranked(shots: DataFrame, items: str, most: int | None) -> DataFrame:
    """KEY, l: the names in `items` of a moment, the most often seen first, of equals the one seen first."""
    each = shots.select(*KEY, "_n", F.posexplode(_set(items)).alias("_p", "x"))
    seen = each.groupBy(*KEY, "x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_n", "_p")).alias("first"))
    kept = first_of(seen, KEY, [F.desc("n"), F.col("first")], most) if most else seen.withColumn("place", F.row_number().over(W.partitionBy(*KEY).orderBy("x")))
    return kept.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("l"))


def facts(shots: DataFrame) -> DataFrame:
    """A row for each moment: begins, ends, shots (their number), part (of the day), place, around (region and country of the first
    shot), population as a line, persons (the most often seen), perhaps (suspected and not confirmed among the first persons),
    captions (first sentences, in order), words (in the order of the alphabet), read (lines of the first legible text), video,
    topic, and longest, the longest caption's sentence."""
    s = clean(shots).withColumn("_n", F.row_number().over(W.partitionBy(*KEY).orderBy("taken_at", "id")))
    told = some("caption") != ""
    first = lambda c: F.min_by(c, "_n")
    each = s.groupBy(*KEY).agg(
        F.min("taken_at").alias("begins"),
        F.max("taken_at").alias("ends"),
        F.count(F.lit(1)).cast("int").alias("shots"),
        first(some("place")).alias("place"),
        first(where_it_is(F.col("region"), F.col("country"))).alias("around"),
        first(F.coalesce("population", F.lit(0))).alias("_people"),
        F.min_by(some("ocr"), F.when(F.length(some("ocr")) > LEGIBLE, F.col("_n"))).alias("_ocr"),
        F.coalesce(F.bool_or(F.col("kind") == "video"), F.lit(False)).alias("video"),
        F.max_by(F.when(told, F.col("caption")), F.struct(F.length(some("caption")), -F.col("_n"))).alias("_long"),
    )
    line = s.where(told).withColumn("_c", F.row_number().over(W.partitionBy(*KEY).orderBy("_n"))).where(F.col("_c") <= CAPTIONS)
    captions = line.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", first_sentence(F.col("caption")).alias("t")))), lambda x: x["t"]).alias("captions"))
    tags = s.select(*KEY, F.explode(_set("tags")).alias("x")).distinct()
    words = tags.withColumn("_c", F.row_number().over(W.partitionBy(*KEY).orderBy("x"))).where(F.col("_c") <= WORDS)
    words = words.groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias("words"))
    marks = F.array(*(F.lit(w) for w in sorted({w for _, m in TOPICS for w in m})))
    seen = s.select(*KEY, F.explode(F.array_intersect(F.concat(_set("tags"), F.array(some("scene"))), marks)).alias("x"))  # no more than the topics' words
    topics = seen.groupBy(*KEY).agg(topic(F.collect_set("x")).alias("topic"))
    names = _ranked(s, "persons", NAMES).withColumnRenamed("l", "persons")
    maybe = _ranked(s, "suggested", None).withColumnRenamed("l", "_perhaps")
    out = each
    for part in (captions, words, topics, names, maybe):
        out = out.join(part, KEY, "left")
    none = F.array().cast("array<string>")
    persons = F.coalesce("persons", none)
    return out.select(
        *KEY, "begins", "ends", "shots", part_of_day(F.col("begins")).alias("part"), "place", "around",
        F.when(F.col("_people") > 0, F.concat(F.translate(F.format_number("_people", 0), ",", "."), F.lit(" Einwohner"))).otherwise("").alias("people_there"),
        persons.alias("persons"), F.array_except(F.coalesce("_perhaps", none), persons).alias("perhaps"), F.coalesce("captions", none).alias("captions"),
        F.coalesce("words", none).alias("words"), F.when(F.length("_ocr") > LEGIBLE, F.slice(legible(F.col("_ocr")), 1, LINES)).otherwise(none).alias("read"), "video",
        F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce(first_sentence(F.col("_long")), F.lit("")).alias("longest"),
    )


def span() -> Column:
    """When the moment of a row of facts was: from and until, or the one time."""
    return F.when(F.col("shots") > 1, F.concat(clock(F.col("begins")), F.lit("–"), clock(F.col("ends")))).otherwise(clock(F.col("begins")))


def story() -> Column:
    """What a page says of a row of facts when nobody wrote it: counted, timed, named."""
    minutes = F.floor((F.unix_micros("ends") - F.unix_micros("begins")) / 60_000_000)
    lasted = F.when(minutes < 3, "").when(minutes < 90, F.concat(F.lit(", "), minutes.cast("string"), F.lit(" Minuten lang"))).otherwise(F.concat(F.lit(", über "), F.floor(minutes / 60).cast("string"), F.lit(" Stunden")))
    at = F.concat(clock(F.col("begins")), F.lit(" Uhr"), F.when(F.col("place") != "", F.concat(F.lit(" in "), F.col("place"))).otherwise(""), lasted)
    opening = F.when(F.col("shots") == 1, F.concat(at, F.lit("."))).otherwise(F.concat(at, F.lit(": "), F.col("shots").cast("string"), F.lit(" Aufnahmen.")))
    n = F.size("persons")
    named = F.when(n == 1, F.element_at("persons", 1)).when(n > 1, F.concat(F.array_join(F.slice("persons", 1, n - 1), ", "), F.lit(" und "), F.element_at("persons", -1)))
    seen = F.when(n > 0, F.concat(F.lit("Zu sehen: "), named, F.lit(".")))
    return F.concat_ws(" ", opening, seen, F.when(F.col("longest") != "", F.col("longest")))


def neighbours(told: DataFrame) -> DataFrame:
    """told (rows of facts) with before and after: when the neighbouring moments of the book were, and their topic; '' at its ends."""
    w = W.partitionBy("book").orderBy("moment")
    short = F.trim(F.concat(clock(F.col("begins")), F.lit(" Uhr "), F.lower("topic")))
    beside = lambda c: F.coalesce(c, F.lit(""))
    return told.withColumn("_s", short).withColumn("before", beside(F.lag("_s").over(w))).withColumn("after", beside(F.lead("_s").over(w))).drop("_s")


def captioned(pages: DataFrame, shots: DataFrame) -> DataFrame:
    """book, page, number (from 1, in the order of the page), id, caption (its first sentence), persons and perhaps (by the
    alphabet), at ('' where the time is guessed): the pictures of each page that carry a line of their own.

    pages: book, page, shots (ids in order; no more than a page has). Pictures without a caption carry none."""
    s = shots.where("book is not null and id is not null").dropDuplicates(["book", "id"])
    on = pages.select("book", "page", F.posexplode("shots").alias("_p", "id")).join(s.where(some("caption") != ""), ["book", "id"])
    persons, maybe = F.array_sort(F.array_distinct(_set("persons"))), F.array_sort(F.array_distinct(_set("suggested")))
    at = F.when(F.coalesce(F.col("guessed"), F.lit(False)) | F.col("taken_at").isNull(), "").otherwise(clock(F.col("taken_at")))
    number = F.row_number().over(W.partitionBy("book", "page").orderBy("_p"))
    return on.select("book", "page", number.alias("number"), "id", first_sentence(F.col("caption")).alias("caption"), persons.alias("persons"), F.array_except(maybe, persons).alias("perhaps"), at.alias("at"))
