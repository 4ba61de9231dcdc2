"""Registered queries over what is told of moments and over drafts of pages, made of events and documents by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import books, drafts, stories
from lumenlake.operators.registry import _query, _t

_GAP = 6 * 60
_SAID = ["glas", "see", "baum", "strand"]


def _shots(spark, sf):
    e, key = _t(spark, sf, "events"), F.col("event_id")
    seen = lambda n, who: F.when(key % n == 0, who)
    shots = e.select(
        (F.col("user_id") % 20).alias("book"), key.alias("id"), F.col("ts").cast("timestamp").alias("taken_at"), (key % 9 == 0).alias("guessed"), F.when(key % 10 == 0, "video").otherwise("image").alias("kind"),
        F.when(key % 3 < 2, F.concat(F.repeat("event_type", (key % 4 + 1).cast("int")), F.lit(". Mehr"))).alias("caption"), F.array(F.element_at(F.array(*map(F.lit, _SAID)), (key % 4 + 1).cast("int"))).alias("tags"), F.when(key % 50 == 0, "park").alias("scene"),
        F.when(key % 12 == 0, F.concat(F.lit("Tageskarte / "), F.repeat(F.lit("ab "), (key % 20).cast("int")))).alias("ocr"), F.array(seen(3, "Anna"), seen(5, "Bert"), seen(7, "Cleo"), seen(2, "Dora")).alias("persons"), F.array(seen(4, "Emil"), seen(6, "Anna")).alias("suggested"),
        F.when(key % 5 > 0, F.concat(F.lit("Ort"), (key % 9).cast("string"))).alias("place"), F.lit("Land").alias("region"), F.when(key % 2 == 0, "DE").alias("country"), (key * 1000).alias("population"),
    )
    return books.moments(shots, _GAP)


_MOMENTS = f"""s AS (SELECT user_id % 20 AS book, event_id AS id, ts, event_type, CASE WHEN event_id % 3 < 2 THEN repeat(event_type, CAST(event_id % 4 + 1 AS INT)) || '.' END AS said FROM events),
c AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {_GAP * 60_000_000} THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY book ORDER BY ts, id)),
m AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY book ORDER BY ts, id) AS INT) AS moment FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY book, moment ORDER BY ts, id) AS n FROM m)"""


@_query(f"""WITH {_MOMENTS}, p AS (SELECT book, moment, who, count(*) AS k, min(n * 10 + pos) AS f FROM r, (VALUES ('Anna', 3, 1), ('Bert', 5, 2), ('Cleo', 7, 3), ('Dora', 2, 4)) v(who, d, pos) WHERE id % d = 0 GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY book, moment ORDER BY k DESC, f) AS nr FROM p), w AS (SELECT book, moment, list(who ORDER BY nr) AS l FROM q WHERE nr <= 3 GROUP BY ALL),
g AS (SELECT book, moment, min(ts) AS b, max(ts) AS e, count(*) AS k, arg_min(CASE WHEN id % 5 > 0 THEN 'Ort' || id % 9 ELSE '' END, n) AS place, arg_max(said, (length(said), -n)) FILTER (said IS NOT NULL) AS longest,
bool_or(id % 4 = 0) AS glas, bool_or(id % 4 = 3) AS strand, bool_or(id % 50 = 0) AS park, bool_or(id % 4 = 1) AS see FROM r GROUP BY ALL), h AS (SELECT *, (epoch_us(e) - epoch_us(b)) // 60000000 AS mins FROM g),
t AS (SELECT h.*, l, CASE WHEN glas THEN 'Bei Tisch' WHEN strand THEN 'Am Strand' WHEN park THEN 'Im Park' WHEN see THEN 'Am Wasser' ELSE '' END AS topic FROM h LEFT JOIN w USING (book, moment)), o AS (SELECT *, trim(strftime(b, '%H:%M') || ' Uhr ' || lower(topic)) AS short FROM t)
SELECT book, moment, topic, coalesce(lag(short) OVER z, '') AS before, coalesce(lead(short) OVER z, '') AS after, concat_ws(' ', strftime(b, '%H:%M') || ' Uhr' || CASE WHEN place <> '' THEN ' in ' || place ELSE '' END
|| CASE WHEN mins < 3 THEN '' WHEN mins < 90 THEN ', ' || mins || ' Minuten lang' ELSE ', über ' || mins // 60 || ' Stunden' END || CASE WHEN k = 1 THEN '.' ELSE ': ' || k || ' Aufnahmen.' END,
CASE len(l) WHEN 1 THEN 'Zu sehen: ' || l[1] || '.' WHEN 2 THEN 'Zu sehen: ' || l[1] || ' und ' || l[2] || '.' WHEN 3 THEN 'Zu sehen: ' || l[1] || ', ' || l[2] || ' und ' || l[3] || '.' END, longest) AS story
FROM o WINDOW z AS (PARTITION BY book ORDER BY moment)""")
def book_stories(spark, sf):
    told = stories.neighbours(stories.facts(_shots(spark, sf)))
    return told.select("book", "moment", "topic", "before", "after", stories.story().alias("story"))


@_query(f"""WITH {_MOMENTS}, x AS (SELECT book, moment, n, id, CASE WHEN id % 12 = 0 AND length('Tageskarte / ' || repeat('ab ', CAST(id % 20 AS INT))) > 25 THEN trim(repeat('ab ', CAST(id % 20 AS INT))) END AS ocr FROM r),
y AS (SELECT book, moment, arg_min(ocr, n) FILTER (ocr IS NOT NULL) AS ocr FROM x GROUP BY ALL), d AS (SELECT book, moment, said, row_number() OVER (PARTITION BY book, moment ORDER BY n) AS k FROM r WHERE said IS NOT NULL),
v AS (SELECT book, moment, string_agg(said, '|' ORDER BY k) AS captions FROM d WHERE k <= 5 GROUP BY ALL), g AS (SELECT book, moment, count(*) AS shots, min(ts) AS b, max(ts) AS e, bool_or(id % 10 = 0) AS video, arg_min(id, n) AS head,
array_to_string(list_sort(list_distinct(list(['glas', 'see', 'baum', 'strand'][id % 4 + 1]))), '|') AS words FROM r GROUP BY ALL)
SELECT book, moment, CAST(shots AS INT) AS shots, strftime(b, '%H:%M') || CASE WHEN shots > 1 THEN '–' || strftime(e, '%H:%M') ELSE '' END AS times, CASE WHEN head % 2 = 0 THEN 'Land, DE' ELSE 'Land' END AS around, CASE WHEN head = 0 THEN '' ELSE replace(format('{{:,}}', head * 1000), ',', '.') || ' Einwohner' END AS people_there,
coalesce(captions, '') AS captions, words, CASE WHEN ocr IS NULL THEN '' WHEN length(ocr) < 46 THEN 'Tageskarte|' || ocr ELSE 'Tageskarte' END AS read, video FROM g LEFT JOIN v USING (book, moment) LEFT JOIN y USING (book, moment)""")
def book_facts(spark, sf):
    told = stories.facts(_shots(spark, sf))
    flat = lambda c: F.array_join(c, "|").alias(c)
    return told.select("book", "moment", "shots", stories.span().alias("times"), "around", "people_there", flat("captions"), flat("words"), flat("read"), "video")


# Fixed rule: what drafts begin with, by their number.
_BEGINS = ["", "Zwei Jungen ", "Blickt ", "Ein Moment ", "Vermutlich ", "Magisch ", "12 Leute ", "Transfer "]


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_EDGE = r"[^\p{L}\p{N}_]"
_RULES = {
    "counted": rf"{_any('al', drafts.COUNTED)} OR regexp_matches(al, '(^|{_EDGE})({'|'.join(drafts.NUMBERS)}|\d+)\s+({'|'.join(drafts.PEOPLE)})($|{_EDGE})')",
    "counting": f"len(list_filter(list_concat([headline], lines), lambda x: regexp_matches(lower(x), '^({'|'.join(drafts.COUNTING)})'))) > 0",
    "posing_headline": _any("lower(headline)", drafts.POSING), "posing_text": _any("tx", drafts.POSING), "nameless": "source <> '' AND NOT contains(al, lower(source))",
    "felt": _any("al", drafts.FELT), "jargon": _any("al", drafts.JARGON), "unknown": _any("al", drafts.UNKNOWN), "hedging": _any("al", drafts.HEDGING),
    "long_headline": r"len(list_filter(regexp_split_to_array(headline, '[\s\x0B]+'), lambda x: x <> '')) > 7", "used": "doc_id % 5 = 0", "line_number": "doc_id % 4 > 0 AND len(lines) <> doc_id % 4",
    "long_line": r"len(list_filter(lines, lambda y: len(list_filter(regexp_split_to_array(y, '[\s\x0B]+'), lambda x: x <> '')) > 9)) > 0",
}


@_query(rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, regexp_replace(coalesce(text, ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS story, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines,
regexp_replace({_BEGINS}[CAST(doc_id % 8 + 1 AS INT)] || array_to_string(string_split(coalesce(text, ''), ' ')[1:5], ' '), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS headline FROM documents),
l AS (SELECT *, lower(array_to_string(list_concat([headline, story], lines), ' ')) AS al, lower(array_to_string(list_concat([story], lines), ' ')) AS tx FROM d),
f AS (SELECT doc_id, CASE WHEN headline = '' OR story = '' THEN ['missing'] ELSE list_filter([{', '.join(f"CASE WHEN {r} THEN '{n}' END" for n, r in _RULES.items())}], lambda x: x IS NOT NULL) END AS found FROM l),
k AS (SELECT doc_id, found, list_transform(found, lambda n: CASE n {' '.join(f"WHEN '{n}' THEN {c}" for n, c in drafts.COSTS.items())} END) AS costs FROM f)
SELECT doc_id, array_to_string(found, ',') AS faults, CAST(coalesce(list_sum(costs), 0) AS INT) AS cost, found[list_position(costs, list_max(costs))] AS worst FROM k""")
def drafts_judged(spark, sf):
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id")
    headline = F.concat(F.element_at(F.array(*map(F.lit, _BEGINS)), (key % 8 + 1).cast("int")), F.array_join(F.slice(F.split(text, " "), 1, 5), " "))
    d = _t(spark, sf, "documents").select(
        "doc_id", headline.alias("headline"), F.col("text").alias("story"), F.when(text != "", F.split(text, "\n")).alias("lines"), F.array("source").alias("names"),
        F.when(key % 5 == 0, F.array(drafts.bare(headline))).alias("used"), (key % 4).alias("wanted"),
    )
    return drafts.judged(d).select("doc_id", F.array_join("faults", ",").alias("faults"), "cost", "worst")
