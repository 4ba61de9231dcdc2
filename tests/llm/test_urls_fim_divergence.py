"""Url filters, fill-in-middle and the divergence audit against plain Python, on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import divergence, fim, queries, urls

RULES = queries.URL_RULES


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# --- urls -----------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme here", "http://", "http://Example.COM", "http://example.com/", "https://a.b.example.com/en/x", "http://WWW.example.com/en/", "http://xexample.com/en/", "http://m.casino-win.example.net/de/1",
    "http://casino-casino.org/", "http://casinos.org/wins", "http://a.net/es/1", "http://a.net/ES/1", "http://a.net?x=/es/", "http://porn.org", "http://pornography.org", "http://a.org/é-porn-é", "http://a.org/éporn",
    "http://a.org/free/bets#x", "http://a.org/?q=free+bets+xxx", "http://user@free.bets.org:80/", "http://net/fr/", "x://y://net/fr/", "http://a.org/" + "a" * 63 + "-spam-farm-" + "b" * 500, "http://a.org/" + "win/" * 20_000 + "free", "http://7bets.org/24free", "http://.com/", "http://com./",
    "http://a.org/\nxxx",
]


def judged(url, strict=urls.STRICT, soft=urls.SOFT):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fits = [(h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    place = lower(host + path)
    edge = "[a-z\u0080-\U0010ffff]"
    hit = lambda t: re.search(f"(?<!{edge}){re.escape(t)}(?!{edge})", place)
    hard, mild = sorted(t for t in strict if hit(t)), sorted(t for t in soft if hit(t))
    rule = max(fits, key=lambda x: len(x[0])) if fits else (None, "block" if hard or len(mild) >= 2 else "allow")
    return host, path, *rule, hard, mild


def test_urls_are_judged_as_by_patterns(spark):
    rows = [(i, u, "h", 1) for i, u in enumerate(URLS)] + [(None, URLS[9], "h", 1), (3, URLS[9], "h", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _place int")
    got = sorted((tuple(r) for r in urls.judge(pages, RULES).collect()), key=repr)
    assert got == sorted(((r[0], *judged(r[1])) for r in rows), key=repr)
    assert urls.judge(pages.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        urls.judge(pages, RULES, key="host")


def test_automaton_finds_what_a_search_finds():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("ab-") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    texts = ["".join(rng.choice("ab-é1") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 400]))).encode() for _ in range(60)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, term = urls.matches(urls.automaton([t.encode() for t in terms]), data, bounds)
    letter = lambda b: b >= 128 or 97 <= b <= 122
    want = Counter()
    for r, x in enumerate(texts):
        for i, t in enumerate(terms):
            t = t.encode()
            for at in range(len(x) - len(t) + 1):
                if x[at : at + len(t)] == t and not (at and letter(x[at - 1])) and not (at + len(t) < len(x) and letter(x[at + len(t)])):
                    want[r, i] += 1
    assert Counter(zip(row.tolist(), term.tolist(), strict=True)) == want


def test_a_table_of_rules_decides_as_the_list(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rules = spark.createDataFrame([*RULES, ("allow", "net", "/es/"), (None, "a.org", "/"), ("block", "", "/")], "action string, host string, path string")
    want = {i: (j[2], j[3] if j[2] else None) for i, u in enumerate(URLS) for j in [judged(u)]}
    assert {r[0]: (r[1], r[2]) for r in urls.by_rule_table(pages, rules).collect()} == want
    assert {r[1] for r in urls.by_rule_table(pages, rules.limit(0)).collect()} == {None}


# --- fill in the middle ---------------------------------------------------------------------------------------------


def texts():
    rng = random.Random(2)
    out = [None, "", "a", "é", "日本語", "with <P> inside", "ends in <", "<S", "M>", "a\x00b", "x" * 1023, "x" * 1024, "é" * 1025, "🎈" * 5000]
    return out + ["".join(rng.choice("aé日🎈 \n<>PSM") for _ in range(rng.choice([3, 50, 3000]))) for _ in range(120)] + ["word " * 130_000]


def test_texts_are_cut_and_rebuilt(spark):
    rows = [(i, t, "plain", 0) for i, t in enumerate(texts())] + [(None, "no key é", "f", 1), (7, "twice", "f", 1), (7, "twice", "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    got = sorted((tuple(r) for r in fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()), key=repr)
    want, forms = [], Counter()
    for key, t, *_ in rows:
        t = t or ""
        h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
        i, j = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        x, y, z = t[:i], t[i:j], t[j:]
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        forms[form] += 1
        out = {"plain": t, "psm": f"<P>{x}<S>{z}<M>{y}", "spm": f"<S>{z}<P>{x}<M>{y}"}[form]
        want.append((key, len(t), form, None if form == "plain" else len(x), None if form == "plain" else len(y), out, t))
    assert got == sorted(want, key=repr) and len(forms) == 3
    assert fim.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("every", [1, 3, 1024])
def test_every_cut_of_the_index(unit, every, monkeypatch):
    monkeypatch.setattr(fim, "COUNTED", 7)  # pieces end within texts and within letters
    pattern = {"char": "(?s).", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    some = ["", "é日 a", "  lead é\n\nnext  ", "", "\n", "one", "🎈🎈 x\ny", ""]
    raw = [t.encode() for t in some]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    ix = fim.index(data, bounds, unit, every)
    for r, t in enumerate(some):
        starts = [m.start() for m in re.finditer(pattern, t)]
        assert (ix.units[r], ix.chars[r]) == (len(starts), len(t))
        assert ix.bounds[r + 1] - ix.bounds[r] == -(-len(starts) // every)
        for k, at in enumerate([*starts, len(t)]):
            byte, char = ix.cut(data, int(bounds[r]), int(bounds[r + 1]), r, k)
            assert (byte - bounds[r], char) == (len(t[:at].encode()), at)


# --- divergence -----------------------------------------------------------------------------------------------------


def audited(rows, least=10, top=10):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    groups, docs, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall(lower(text or ""))
        groups[lang].add(source)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        share = lambda c, kept=kept, v=v: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -x, i + 1) for i, (x, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -x, i + 1) for i, (x, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = [f"{c}{d}" for c in ("Wort", "é", "日", "x'y", "ZZ") for d in "abcdefgh"] + [chr(i) * 3 for i in range(97, 123)]
    rows = []
    for i in range(700):
        lang, source = rng.choice(["en", "en", "en", "de", None]), f"s{min(rng.randrange(30), 17)}"  # one source has a third of the rows
        pick = words[: 20 + 3 * int(source[1:])]
        rows.append((" ".join(rng.choice(pick) for _ in range(rng.randint(0, 40))), lang, source))
    rows += [(None, "en", "silent"), ("", "fr", "one"), ("123 456", "fr", None), ("rare words", "fr", "two"), ("alone", "it", "only")]
    rows += [("tie tie 1 tye", "tt", f"t{i % 2}") for i in range(30)] + rows[:3]
    return rows


def test_divergence_equals_plain_sums(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, round int")
    got = divergence.audit(docs.repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = audited(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)
    assert divergence.audit(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", range(2, 12))
def test_each_two_blocks_meet_once(spark, blocks):
    m = blocks + blocks % 2
    turns = spark.range(blocks).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(m - 2))).alias("r"))
    rows = turns.select("b", "r", divergence.opponent(F.col("b"), F.col("r"), F.lit(blocks)).alias("o")).collect()
    met = {(x.r, x.b): x.o for x in rows}
    assert all(met.get((r, o), b) == b and o != b for (r, b), o in met.items())
    pairs = [(b, o) for (r, b), o in met.items() if o < blocks]
    assert sorted(pairs) == sorted((a, b) for a in range(blocks) for b in range(blocks) if a != b)


def test_shares_are_exact_for_large_counts():
    rng = random.Random(6)
    for _ in range(300):
        total, terms = rng.randrange(1, 8 * 10**15), rng.randrange(1, 10**8)
        n = rng.randrange(total)
        assert divergence.shares(np.array([n]), total, terms)[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


@pytest.mark.parametrize("name", ["op11_url_filters", "op12_fill_in_middle", "op13_source_divergence"])
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == columns
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want.fetchall()))
