"""The full-text and trigram indexes against plain Python."""

import math
import random
import re

import pytest

from lumenlake.operators import index_queries as Q
from lumenlake.operators import postings, stems, trigrams

SCHEMA = f"source string, key long, moment double, german boolean, fields {postings.FIELDS}"


def test_stems():
    # From the published vocabulary of the algorithm.
    want = {
        "aufeinander": "aufeinand", "kategorie": "kategori", "kategorischen": "kategor", "häuser": "haus", "jährlichen": "jahrlich", "bedürfnissen": "bedurfnis", "bedürfnis": "bedurfnis", "derbsten": "derb",
        "ängstlich": "angstlich", "großes": "gross", "kätzchen": "katzch", "katers": "kat", "aufgeregte": "aufgeregt", "aufgabe": "aufgab", "katholischen": "kathol", "freundlichkeit": "freundlich", "bauer": "bau", "a": "a", "": "", "tage": "tag", "tagen": "tag", "neuen": "neu",
    }
    assert {w: stems.german(w) for w in want} == want


def fits(words, german, alternatives):
    """words of a text in order (None where one is left out); whether an alternative of (missing, words) fits."""
    lex = lambda w: (None if w in stems.STOP else stems.german(w)) if german else w
    for alternative in alternatives:
        every, used = True, False
        for missing, asked in alternative:
            at = [(lex(w), i) for i, w in enumerate(asked) if lex(w) is not None]
            if not at:
                continue
            used = True
            has = any(all(0 <= p + i < len(words) and words[p + i] == t for t, i in at) for p in range(-len(asked), len(words)))
            every &= has != missing
        if used and every:
            return True
    return False


def searched(rows, phrase, alternatives, weights, by_length, most=200):
    best = {}
    for source, key, moment, german, fields in rows:
        if source not in weights or key is None:
            continue
        german, lex = bool(german), lambda w, g=german: (None if w in stems.STOP else stems.german(w)) if g else w
        split = [([lex(w) for w in re.findall(r"[^\W_]+", (text or "").lower())], {"A": 1.0, "B": 0.4, "C": 0.2}.get(label, 0.1), start) for label, text, start in fields or []]
        words = [w for f in split for w in f[0]]
        if not fits(words, german, alternatives):
            continue
        wanted = list(dict.fromkeys(t for a in alternatives for missing, asked in a if not missing for t in map(lex, asked) if t is not None))
        total = 0.0
        for t in wanted:
            c = [count for f, count, _ in split for w in f if w == t]
            if c:
                j = c.index(max(c)) + 1
                total += (max(c) + sum(x / i**2 for i, x in enumerate(c, 1)) - max(c) / j**2) / 1.64493406685
        length = sum(w is not None for w in words)
        score = weights[source] * total / max(len(wanted), 1) / (1 + math.log(max(length, 1)) if by_length else 1)
        if moment is None:
            moment = min((s for f, _, s in split if s is not None and fits(f, german, alternatives)), default=None)
        new = (-round(score, 6), math.inf if moment is None else moment)
        best[key] = min(best.get(key, new), new)
    top = sorted((s, k, m) for k, (s, m) in best.items())[:most]
    return [(k, None if m == math.inf else m, -s, i + 1) for i, (s, k, m) in enumerate(top)]


def texts():
    rng = random.Random(9)
    words = ["Haus", "Häuser", "Hause", "und", "der", "See", "Seen", "am", "Wald", "waldig", "schöne", "schönen", "42", "Ü", "日本", "x-ray"]
    rows = []
    for i in range(300):
        some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
        fields = [(label, some(12), None) for label in rng.sample(["A", "B", "C", None], rng.randrange(1, 4))]
        rows.append((rng.choice(["caption", "frame", "meta"]), i // 2, rng.choice([None, 1.0, 5.0]), rng.choice([True, False]), fields))
        if i % 3 == 0:
            rows.append(("speech", i, None, True, [("A", some(8), 2.0 * j) for j in range(rng.randrange(5))]))
    return rows + [("caption", 500, None, None, None), ("caption", 501, None, True, []), ("meta", 502, None, False, [("A", None, None)]), ("caption", None, None, True, [("A", "Haus", None)]), ("other", 1, None, True, [("A", "Haus", None)]), rows[0]]


@pytest.fixture(scope="module")
def index(spark):
    return postings.build(spark.createDataFrame(texts(), SCHEMA).repartition(3))


WEIGHTS = {"caption": 1.0, "frame": 0.9, "meta": 0.5, "speech": 0.9}


@pytest.mark.parametrize("by_length", [False, True])
@pytest.mark.parametrize(
    "phrase,alternatives",
    [
        ("Häuser", [[(False, ["häuser"])]]),
        ("haus -see", [[(False, ["haus"]), (True, ["see"])]]),
        ('"schöne häuser" OR 42 日本', [[(False, ["schöne", "häuser"])], [(False, ["42"]), (False, ["日本"])]]),
        ('"haus am see"', [[(False, ["haus", "am", "see"])]]),  # a word that is left out keeps its place
        ("-wald", [[(True, ["wald"])]]),
        ('-"see wald" ü', [[(True, ["see", "wald"]), (False, ["ü"])]]),
        ("x-ray und", [[(False, ["x", "ray"]), (False, ["und"])]]),
        ("und", [[(False, ["und"])]]),
        ("... !", []),
    ],
)
def test_search_equals_a_scan(index, phrase, alternatives, by_length):
    assert postings.parsed(phrase) == alternatives
    got = [tuple(r) for r in postings.search(index, phrase, WEIGHTS, by_length=by_length).orderBy("rank").collect()]
    assert got == searched(texts(), phrase, alternatives, WEIGHTS, by_length)


def test_search_reads_its_postings_alone(spark, index):
    df = postings.search(index, "haus", WEIGHTS, 3, keys=spark.createDataFrame([(2,), (2,), (9,), (None,)], "key long"))
    assert {r["key"] for r in df.collect()} <= {2, 9}
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan or "In(term" in plan or "EqualTo(term" in plan
    empty = postings.build(spark.createDataFrame([], SCHEMA))
    assert postings.search(empty, "haus OR -see", WEIGHTS).count() == 0


def test_german_query(spark, sf):
    want, talks = [], {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want.append(("analyses", r["doc_id"], None, r["lang"] == "de", [("A", r["text"], None)]))
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    want += [("speech", k, None, True, [("A", t, float(turn)) for turn, t in sorted(v)]) for k, v in talks.items()]
    want = searched(want, "", [[(False, ["heiten"])], [(False, ["erten"]), (True, ["the"])]], {"analyses": 1.0, "speech": 0.9}, False)
    assert [tuple(r) for r in Q.german_words(spark, sf).orderBy("rank").collect()] == want and want


def like(query, name):
    grams = lambda s: [g for w in re.findall(r"[^\W_]+", s.lower()) for g in [f"  {w} "[i : i + 3] for i in range(len(w) + 1)]]
    q, g = set(grams(query)), grams(name)
    return round(max((len(q & set(g[i:j])) / len(q | set(g[i:j])) for i in range(len(g)) for j in range(i + 1, len(g) + 1)), default=0.0), 6) if q else 0.0


def test_names_are_alike_by_their_best_stretch(spark):
    names = ["two words", "word", "words of wood", "wo xx rd or d", "Straße am See", "strasse", "", None, "日本 word", "a", "2019 Urlaub/IMG_0042.jpg", "word " * 30, "sword worded"]
    rows = [(i, n, names[-1 - i] if i % 2 else None) for i, n in enumerate(names)] + [(None, "word", None), (1, "nothing", None), (1, "word", None)]
    index = trigrams.build(spark.createDataFrame(rows, "key long, name string, other string"), "key", ["name", "other"])
    for query in ("word", "wrod words", "am see", "img 42", "日本", "a", "?"):
        for least in (0.3, 0.5) if query == "word" else (0.3,):
            want = {}
            for key, *both in rows:
                for n in both:
                    if key is not None and n is not None and like(query, n) >= least:
                        want[key] = max(want.get(key, 0), like(query, n))
            assert {r[0]: r[1] for r in trigrams.alike(index, query, least).collect()} == want
    assert like("word", "two words") == 0.8 and like("abcdef", "abc x def") < like("abcdef", "xx abcdef")
    assert trigrams.alike(index, "word", most=2).count() == 2
    assert "In(gram" in trigrams.alike(index, "word")._jdf.queryExecution().toString()
    assert trigrams.alike(trigrams.build(spark.createDataFrame([], "key long, name string"), "key", ["name"]), "word").count() == 0


def test_texts_are_worked_on_in_blocks_of_bounded_size():
    import pyarrow as pa

    texts = [["ab " * (5 + i % 7), ""] for i in range(40)] + [["xy zz " * 200_000, "ab"], ["", ""], []] + [["ab, ärger²"] for _ in range(30)]
    n = len(texts)
    b = pa.record_batch([pa.array(range(n)), pa.array(["s"] * n), pa.array(range(n)), pa.array([0.0] * n), pa.array([i % 2 == 0 for i in range(n)]), pa.array(texts, pa.list_(pa.string())), pa.array([[1.0] * len(t) for t in texts]), pa.array([[None] * len(t) for t in texts], pa.list_(pa.float64()))], ["id", "source", "key", "moment", "german", "texts", "counts", "starts"])
    out = list(postings._analysed(iter([b])))
    assert len(out) > 2  # the long text parts the batch
    got = {(r["id"], r["term"]): (r["length"], r["places"]) for part in out for r in part.to_pylist()}
    assert got[40, "xy"][0] == 400_001 and got[40, "ab"][1] == [400_001] and got[41, None] == (0, None) and got[42, None] == (0, None)
    assert got[43, "ärger²"][1] == [2] and got[44, "arger²"][1] == [2] and got[3, "ab"][1] == list(range(1, 9)) and sum(t is None for _, t in got) == n
