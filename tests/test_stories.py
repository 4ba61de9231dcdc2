"""What is told of moments, and what is wrong with drafts, against plain Python and by cases."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from lumenlake.operators import drafts, stories

SHOT = "book long, moment int, id long, taken_at timestamp, guessed boolean, kind string, caption string, tags array<string>, scene string, ocr string, persons array<string>, suggested array<string>, place string, region string, country string, population long"
T0 = dt.datetime(2024, 6, 1, 8)
NAMES = ["Anna", "Bert", "Cleo", "Dora", "Emil"]


def sentence(text):
    s = text.split(". ")[0].strip()
    return s if s.endswith(".") else s + "."


def album(n, seed=4):
    rng = random.Random(seed)
    some = lambda items, most: rng.choice([None, [], rng.choices(items, k=rng.randint(1, most))])
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=rng.choice([0, 1, 3, 50, 89, 90, 300]) + (i // 4) * 7)
        rows.append((rng.randrange(2), rng.randrange(n // 4), i, at, rng.random() < 0.2, rng.choice(["image", "video", None]), rng.choice([None, "", "kurz", "Ein Satz. Und mehr.", "Ende."]), some(["glas", "see", "baum", "auto", "", None], 3), rng.choice([None, "", "strand", "wald"]),
                     rng.choice([None, "zu kurz", "x" * 70, "Karte / Suppe, \nEis / ab / " + "z" * 50]), some([*NAMES, None], 4), some(NAMES, 2), rng.choice([None, "", "Rom"]), rng.choice([None, "Latium"]), rng.choice([None, "", "Italien"]), rng.choice([None, 0, 1234567])))
    return rows


def told(rows):
    """(book, moment) -> what facts and story say, one moment after the other."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        groups.setdefault((r[0], r[1]), []).append(r)
    out = {}
    for at, run in groups.items():
        names = Counter(n for r in run for n in r[10] or [] if n)
        persons = [n for n, _ in names.most_common(3)]
        maybe = sorted({n for r in run for n in r[11] or []} - set(persons))
        captions = [sentence(r[6]) for r in run if r[6]]
        words = sorted({w for r in run for w in r[7] or [] if w})
        marks = set(words) | {r[8] for r in run if r[8]}
        topic = next((name for name, m in stories.TOPICS if marks & set(m)), "")
        ocr = next((r[9] for r in run if len(r[9] or "") > 25), None)
        lines = []
        if ocr:
            pieces = [p.strip(" .,·") for p in ocr.replace("\n", "/").split("/")]
            lines = [p for p in pieces if 2 < len(p) < 46][:3] or [ocr[:60]]
        first, minutes = run[0], int((run[-1][3] - run[0][3]).total_seconds() // 60)
        text = f"{first[3]:%H:%M} Uhr" + (f" in {first[12]}" if first[12] else "")
        if minutes >= 3:
            text += f", {minutes} Minuten lang" if minutes < 90 else f", über {minutes // 60} Stunden"
        text += "." if len(run) == 1 else f": {len(run)} Aufnahmen."
        if persons:
            text += " Zu sehen: " + (", ".join(persons[:-1]) + " und " if len(persons) > 1 else "") + persons[-1] + "."
        long = max(run, key=lambda r: len(r[6] or ""))[6]
        text += " " + sentence(long) if long else ""
        around = ", ".join(x for x in (first[13], first[14]) if x)
        people = f"{first[15]:,} Einwohner".replace(",", ".") if first[15] else ""
        out[at] = (len(run), around, people, persons, maybe, captions[:5], words[:10], lines, any(r[5] == "video" for r in run), topic, text)
    return out


def test_facts_and_story(spark):
    rows = album(160)
    bad = [(None, *rows[0][1:]), (0, None, 900, *rows[0][3:]), (0, 1, None, *rows[0][3:]), (0, 1, 901, None, *rows[0][4:])]
    frame = spark.createDataFrame([*rows, rows[0], *bad], SHOT).withColumn("_n", F.lit("clash")).drop("_n").repartition(5)
    got = stories.facts(frame).withColumn("story", stories.story()).collect()
    cols = ["shots", "around", "people_there", "persons", "perhaps", "captions", "words", "read", "video", "topic", "story"]
    assert {(r["book"], r["moment"]): tuple(r[c] for c in cols) for r in got} == told(rows)
    assert stories.facts(frame.limit(0)).count() == 0


def test_neighbours_and_captions(spark):
    rows = album(60)
    frame = spark.createDataFrame(rows, SHOT)
    near = stories.neighbours(stories.facts(frame)).orderBy("book", "moment").collect()
    for a, b in zip(near, near[1:], strict=False):
        if a["book"] == b["book"]:
            assert b["before"] == f"{a['begins']:%H:%M} Uhr {a['topic'].lower()}".strip() and a["after"] == f"{b['begins']:%H:%M} Uhr {b['topic'].lower()}".strip()
        else:
            assert a["after"] == "" and b["before"] == ""
    one = [r for r in rows if r[0] == 0][:8]
    pages = spark.createDataFrame([(0, 1, [r[2] for r in one] + [777]), (0, 2, []), (0, 3, None)], "book long, page int, shots array<long>")
    want = [r for r in one if r[6]]
    got = stories.captioned(pages, frame).orderBy("number").collect()
    assert [(r["number"], r["id"], r["caption"], r["at"]) for r in got] == [(i + 1, r[2], sentence(r[6]), "" if r[4] else f"{r[3]:%H:%M}") for i, r in enumerate(want)]
    assert [r["perhaps"] for r in got] == [sorted(set(r[11] or []) - set(r[10] or [])) for r in want]


DRAFT = "book long, page int, draft int, headline string, story string, lines array<string>, names array<string>, used array<string>, wanted int"
CASES = [
    ("Zum Flughafen", "Der Tag fängt an.", [], [], [], 0, []),
    (None, "Ein Satz.", None, None, None, None, ["missing"]),
    ("Etwas", " \n ", [], [], [], 0, ["missing"]),
    ("Am Tisch", "Elf Freunde, 12  Leute am Tisch.", [], [], [], 0, ["counted"]),
    ("Am Tisch", "Sie zählen bis neun. Menschen gehen.", [], [], [], 0, []),
    ("Am Tisch", "Achtzehn Leute", [], [], [], 0, []),
    ("Drei Eis", "Schön war es.", ["Mehrere Kugeln"], [], [], 1, ["counting"]),
    ("Matteo schaut hinaus", "Der Flug.", [], ["Matteo"], [], 0, ["posing_headline"]),
    ("Im Flug", "Er blickt hinaus.", [], ["", None], [], 0, ["posing_text"]),
    ("Im Flug", "Es geht los.", [], ["Matteo", "Anna"], [], 0, ["nameless"]),
    ("Im Flug", "Es geht los.", ["matteo winkt"], ["Matteo"], [], 1, []),
    ("Abenteuer", "Ganz magisch!", [], [], [], 0, ["felt"]),
    ("Der Transfer", "Nach der Landung, vielleicht.", [], [], [], 0, ["jargon", "unknown", "hedging"]),
    ("eins zwo drei vier fünf sechs sieben acht", "Da.", [], [], [], 0, ["long_headline"]),
    ("Am Meer", "Da.", [], [], ["AM MEER", None], 0, ["used"]),
    ("Am Meer", "Da.", ["a", None], [], [], 3, ["line_number"]),
    ("Am Meer", "Da.", ["a b c d e f g h i j"], [], [], 1, ["long_line"]),
]


def test_faults(spark):
    rows = [(1, i // 2, i, *c[:6]) for i, c in enumerate(CASES)]
    frame = spark.createDataFrame(rows, DRAFT)
    got = {r["draft"]: r for r in drafts.judged(frame).collect()}
    for i, c in enumerate(CASES):
        assert got[i]["faults"] == c[6], (c, got[i]["faults"])
        assert got[i]["cost"] == sum(drafts.COSTS[f] for f in c[6])
        assert got[i]["worst"] == (max(c[6], key=lambda f: drafts.COSTS[f]) if c[6] else None)
    want = {}
    for i, r in got.items():
        want[r["page"]] = min(want.get(r["page"], (999, 0)), (r["cost"], i))
    assert {r["page"]: (r["cost"], r["draft"]) for r in drafts.best(frame).collect()} == want
    assert drafts.best(frame.limit(0)).count() == 0


def test_a_draft_is_joined_and_lowered_once(spark):
    frame = spark.createDataFrame([(1, 1, 1, "Am Meer", "Da.", [], [], [], 0)], DRAFT)
    plan = drafts.judged(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(array_join(") <= 2 and plan.count("trim(") <= 2  # not once for each word of each rule
    texts = ["x" + " " * 300_000 + "y", "x-zwei\u0085  leute", "x²12 leute", "12 leute_", "vier\n(leute", " " + "a " * 9 + "\n", "Ein moment", "ein\u00a0moment"]
    lines = [(1, 1, i, "Am Meer", t, [t], [], [], 1) for i, t in enumerate(texts)]
    got = {r["draft"]: r["faults"] for r in drafts.judged(spark.createDataFrame(lines, DRAFT)).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [], 4: [], 5: [], 6: ["counting"], 7: []}
    assert drafts.judged(spark.createDataFrame([(1, 1, 0, "Am Meer", "x-zwei \n leute?", [], [], [], 0)], DRAFT)).first()["faults"] == ["counted"]
