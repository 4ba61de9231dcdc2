"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import common as C
from lumenlake.llm import decontam, graph, html, jaccard, langid, lines, lm, pieces, pipeline, quality, queries, shards, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def awkward():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "日本", "x", "#", "don't"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    texts = list(base)
    for t in base[:12]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t, t.upper()]
    texts += [None, "", "   ", "\n\n", "one", "one", "two words", "Same line\n same LINE \nother", " ".join(rng.choice(words) for _ in range(30_000))]
    texts += [f"Common footer line\n{t}\nend {i % 3}" for i, t in enumerate(base[:14])]
    rows = [(i + 1, t, None if i % 9 == 0 else "en", None, 0, i, "r") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[-1], (None, "no id here at all", "en", "s", 1, 1, "r")]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t, *_ in rows]
    top = {i: i for i in range(len(sets))}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if d is not None and sets[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        low[find(i)].append(d)
    return [(d, len(a), None if d is None else min(x for x in low[find(i)] if x is not None) if a else d) for i, (d, a) in enumerate(sets)]


def test_jaccard_join(spark, rows, docs, none):
    for k, percent in ((4, 85), (5, 80)):
        same([tuple(r) for r in jaccard.near_components(docs, k, percent).collect()], components(rows, k, percent))
    assert jaccard.near_components(none).count() == 0


def test_jaccard_hot_region_recurs(spark, monkeypatch):
    """One base in copies edited to around the threshold, so that many nodes are open at their pivot, cut into many pieces."""
    monkeypatch.setattr(jaccard, "PIECE", 16)
    monkeypatch.setattr(jaccard, "PAIRS", 8)
    monkeypatch.setattr(jaccard, "NEAREST", (1, 3, 1 << 62))
    rng = random.Random(11)
    base = [[f"b{j}_{i}" for i in range(80)] for j in range(2)]
    rows = []
    for i in range(300):
        w = list(base[i % 2 if i % 7 else 0])
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w + base[1][:5]), None, None, 0, 0, ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, percent in ((4, 85), (5, 80)):
        want = components(rows, k, percent)
        assert 1 < len({c for _, _, c in want}) < 300
        same([tuple(r) for r in jaccard.near_components(docs, k, percent).collect()], want)


def test_jaccard_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(1 << 60, n, replace=False).astype(np.uint64)) for n in (1, 50, 900)]
    sets += [np.sort(np.concatenate([sets[2][:800], sets[1]])), np.zeros(0, np.uint64)]
    s = jaccard.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(s[i] ^ s[j]).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 4)], "a long, b long")
    same([tuple(r) for r in graph.components(e).collect()], [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)])


def line_dedup(rows, least):
    strip = " \t\n\x0b\x0c\r"
    docs_of = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if x.strip(strip):
                docs_of[lower(x.strip(strip))].add(d)
    out = []
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not x.strip(strip) or len(docs_of[lower(x.strip(strip))]) < least]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(rows, docs, none):
    for least in (2, 10):
        same([tuple(r) for r in lines.line_dedup(docs, least).collect()], line_dedup(rows, least))
    assert lines.line_dedup(none).count() == 0


def test_line_dedup_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    want = con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({lines.ORACLE})").fetchall()
    same([tuple(r) for r in queries.op8_line_dedup(spark, sf).collect()], want)


def test_line_dedup_keeps_first_and_long_passages(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    d = spark.createDataFrame([(1, f"a\n{passage}"), (2, f"{passage}\nb"), (3, passage), (4, "short"), (5, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r["_kept"] for r in lines.dedup_text(d, 10, True, 50, 2).collect()}
    assert got == {1: f"a\n{passage}", 2: "b", 3: "", 4: "short", 5: "short"}


def test_line_order_is_streamed_without_another_shuffle(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3] + [9] * 6), rng.choice([0, 7]), rng.choice([None, *range(40)]), rng.randrange(9)) for _ in range(3000)]
    d = spark.createDataFrame(rows, "h long, h2 long, _doc long, pos int")
    got = lines.marked(d, 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    where = got.select("*", F.spark_partition_id().alias("part")).collect()
    assert len({r["part"] for r in where if r["h"] == 9}) > 1  # the hot key lies in several ranges
    once = Counter((r["h"], r["h2"], r["_doc"], r["pos"]) for r in where if r["once"])
    least = {}
    for h, h2, doc, pos in rows:
        least[h, h2, doc] = min(pos, least.get((h, h2, doc), pos))
    assert once == Counter((*k, v) for k, v in least.items())


def test_clashing_names(spark):
    extra = ["_doc", "_text_hash", "_lost", "_bits", "_lines", "_kept", "_n_lines", "_N_dropped", "_bytes", "_score", "_gone", "_hit"]
    d = spark.createDataFrame([(1, "a b c\nx", *range(12)), (2, "A B C\ny", *range(12))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    got = lines.dedup_text(d, 2, names=("k", "n", "lost"))
    assert got.columns == [*d.columns, "k", "n", "lost"] and {(r["doc_id"], r["k"], r["n"], r["lost"], r["_doc"], r["_lines"]) for r in got.collect()} == {(1, "x", 2, 1, 0, 4), (2, "y", 2, 1, 0, 4)}
    assert toxicity.apply(d, None, d.columns, "s").columns == [*d.columns, "s"] and toxicity.apply(d, None, d.columns, "s").count() == 2
    for stage in (pipeline.drop_lines, pipeline.drop_near):
        assert stage(spark, d, "").columns == d.columns and stage(spark, d, "").count() == 2


def test_rows_with_one_doc_id_do_not_add_up(spark):
    w = [f"w{i}" for i in range(24)]
    d = spark.createDataFrame([(1, " ".join(w[:14])), (1, " ".join(w[10:])), (2, " ".join(w)), (2, " ".join(w[:23]))], "doc_id long, text string")
    got = decontam.contained(d, spark.createDataFrame([(9, " ".join(w))], "item_id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(2, 9, 20, 20, 1.0)]


def test_a_text_that_holds_an_item_meets_its_sketch(spark, monkeypatch):
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n + 4))) for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 40, 100, 257)]
    found = decontam.item_shingles(spark.createDataFrame(items, "item_id long, text string"), 5, 0.8).collect()
    for n, _ in items:
        mine = [r for r in found if r["_item"] == n]
        sketch = sum(r["sketched"] for r in mine)
        assert len(mine) == n and sketch > n - -(-4 * n // 5) and sketch <= max(1, 0.4 * n + 1)  # so many may be missing, and one more
    docs = spark.createDataFrame([(n, f"before {t} after") for n, t in items], "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contained(docs, frame).collect()} == {(n, n) for n, _ in items}
    real = decontam.item_shingles
    monkeypatch.setattr(decontam, "item_shingles", lambda *a: real(*a).withColumn("sketched", F.col("sketched") & F.lit(False)))
    assert decontam.contained(docs, frame).count() == 0  # pairs come through the sketches only


def test_stages_keep_unlike_rows_of_one_doc_id(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    d = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, f"{b} more"), (4, c), (4, a + " tail"), (None, a)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in pipeline.drop_near(spark, d, "").where("doc_id is not null").collect()) == [(1, a), (2, b), (4, c)]
    spark.createDataFrame([(1, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in pipeline.drop_leaks(spark, d, str(tmp_path)).collect()) == [(0, a), (1, a), (2, a), (4, a + " tail"), (4, c)]


def test_contained(spark, rows, docs, none):
    items = [(1, rows[0][1]), (2, rows[5][1].upper()), (3, "one"), (4, "no such words anywhere in it"), (5, None), (6, ""), (7, rows[0][1])]
    got = decontam.contained(docs, spark.createDataFrame(items, "item_id long, text string"))

    def windows(text, n):
        w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))
        return w, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in items:
        w, _ = windows(t, 5)
        n = min(5, len(w))
        s = windows(t, n)[1] if n else set()
        for d, x, *_ in rows:
            if s and d is not None:
                hit = len(s & windows(x, n)[1])
                if hit >= 0.8 * len(s) - 1e-9:
                    want.add((d, i, len(s), hit, hit / len(s)))
    same([tuple(r) for r in got.collect()], want)
    assert decontam.contained(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.contained(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_sentencepiece_round_trip(docs, rows, none):
    for d, t in pieces.decode_docs(pieces.encode_docs(docs.select("doc_id", "text"))).select("text", "decoded").collect():
        assert (d or "") == t
    assert all(r["exact"] for r in pieces.roundtrip(docs).collect()) and pieces.roundtrip(docs).count() == len(rows)
    assert pieces.roundtrip(none).count() == 0


def test_sentencepiece_best_path():
    sp = pieces._model(pieces.MODEL)
    known = {sp.pieces[i]: i for i, k in enumerate(sp.kinds) if k in (1, 4)}
    rng = random.Random(5)
    chunks = ["".join(rng.choice("▁abcdeäß日thingero") for _ in range(rng.randint(1, 14))).encode() for _ in range(200)]
    for c, ids in zip(chunks, sp.encode_chunks(chunks), strict=True):
        text = c.decode()
        best = [0.0] + [-np.inf] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                p = known.get(text[s:e].encode())
                cost = sp.score[p] if p is not None else sp.byte_score * len(text[s:e].encode()) if e == s + 1 else -np.inf
                best[e] = max(best[e], best[s] + cost)
        got = sum(sp.score[i] if sp.kinds[i] != 6 else sp.byte_score for i in ids)
        assert b"".join(sp.surface[i] for i in ids) == c and got == pytest.approx(best[-1])


def test_token_shards(spark, rows, docs, none):
    index, folder, total = shards.materialise(docs, length=32, per_shard=50)
    got = sorted((r["stream"], r["seq"], r["slot"], r["shard"] * 50 + r["offset"] // 64, r["tokens_sha256"], r["doc_ids"]) for r in index.collect())
    assert sorted(g[2] for g in got) == list(range(total)) and all(g[2] == g[3] for g in got)
    stored = list(shards.read_from(folder, 0, 32, 50))
    assert len(stored) == total and [hashlib.sha256(stored[g[2]].tobytes()).hexdigest() for g in got] == [g[4] for g in got]
    for slot in (0, 49, 50, 77, total - 1):
        assert [x.tolist() for x in shards.read_from(folder, slot, 32, 50)] == [x.tolist() for x in stored[slot:]]
    with open(shards.VOCABULARY, "rb") as f:
        enc = shards._encoding(f.read())
    found, open_text = [], None
    for stream, seq, slot, _, _, ids in got:
        texts = np.split(stored[slot], np.flatnonzero(stored[slot][:-1] == shards.END) + 1)
        assert len(texts) == len(ids) and (seq > 0 or open_text is None)
        for d, t in zip(ids, texts, strict=True):
            if open_text:
                assert open_text[0] == d
                t = np.concatenate([open_text[1], t])
            open_text = (d, t) if t[-1] != shards.END else None
            if not open_text:
                found.append((d, t.tolist()))
    assert not open_text
    same(found, [(d, [*enc.encode_ordinary(t or ""), shards.END]) for d, t, *_ in rows])
    assert shards.materialise(none)[0].count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        a, b = shards.feistel(np.arange(n), n, 1), shards.feistel(np.arange(n), n, 2)
        assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n)) and (n < 10 or a.tolist() != b.tolist())


def test_lm_counts_and_base(spark, rows, docs, none):
    learn = docs.where(C.fold(docs["doc_id"], 10) != 0)
    got = lm.apply(docs, *lm.fit(learn, every=1)).collect()
    words = lambda t: [*WORD.findall(lower(t or "")), None]
    c = Counter(w for d, t, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 10 for w in words(t))
    n, v = sum(c.values()), len(c)
    want = {(d, t): (len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for d, t, *_ in rows}
    left = sorted((key((r["doc_id"],)), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
    assert left == sorted((key((d,)), *want[d, t][:3], round(want[d, t][3], 4)) for d, t, *_ in rows)
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    empty = lm.apply(docs, *lm.fit(none)).collect()
    assert len(empty) == len(rows) and {r["n_known"] for r in empty} == {0}
    assert lm.apply(none, *lm.fit(learn, every=1)).count() == 0


def test_lm_rare_words_are_joined_alike(spark, docs, monkeypatch):
    learn = docs.where("doc_id > 5")
    model, counts = lm.fit(learn, every=1)
    few = lm.LanguageModel(**{**model.__dict__, "h": model.h[:0], "c": model.c[:0]})
    a, b = (sorted((key((r["doc_id"],)), r["n_known"], round(r["base_score"], 3)) for r in lm.apply(docs, m, counts).collect()) for m in (model, few))
    assert a == b


def test_lm_rare_words_score_alike(spark, docs, monkeypatch):
    learn = docs.where("doc_id > 5")
    model, counts = lm.fit(learn, every=1)
    few = lm.LanguageModel(**{**model.__dict__, "h": model.h[:0], "c": model.c[:0]})
    a, b = (sorted((key((r["doc_id"],)), r["n_tokens"], r["score"]) for r in lm.apply(docs, m, counts).collect()) for m in (model, few))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b], rel=1e-5, abs=1e-5)
    monkeypatch.setattr(lm, "TABLE", len(model.h) // 3)
    cut, _ = lm.fit(learn, every=1)
    assert 0 < len(cut.h) < len(model.h)
    assert cut.layer.vector == pytest.approx(model.layer.vector, rel=1e-3, abs=1e-4)


def test_lm_learns_from_every_text(spark, docs):
    learn = docs.where("doc_id > 5").select("doc_id", "text")
    x = [lm.langid.vectors(lm.langid.counts(d, b), np.ones(lm.langid.BINS, np.float32)) for r in learn.collect() for d in [np.frombuffer((r["text"] or "").encode(), np.uint8)] for b in [np.array([0, len(d)])]]
    x = np.concatenate(x)
    c = lm._centers(learn, start=8, rounds=20)
    near = np.argmax(x @ c.T, 1)
    for k in np.unique(near):  # each center is the mean of all texts nearest to it, not of those it started from
        mean = x[near == k].sum(0)
        assert c[k] == pytest.approx(mean / np.sqrt((mean * mean).sum()), abs=1e-4)
    a, b = lm.fit(learn)[0].layer.vector, lm.fit(learn, every=1)[0].layer.vector
    assert (a == b).all()


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where(C.fold(docs["doc_id"], 10) == 0)
    model, counts = lm.fit(docs.where(C.fold(docs["doc_id"], 10) != 0).select("doc_id", "text"))
    whole, blind = (lm.apply(held, model, counts, attend).toPandas() for attend in (True, False))
    gain = (whole["score"] - whole["base_score"]).sum() / whole["n_tokens"].sum()
    print("gain a token", gain, "without attention", (blind["score"] - blind["base_score"]).sum() / whole["n_tokens"].sum())
    assert gain > 0.1
    assert whole["score"].sum() > blind["score"].sum()


def test_attention_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 40)
    t = lm.Tokens(np.arange(5, dtype=np.uint64), h, np.array([0, 40]), np.array([3, 9, 4, 7, 2, 5]), np.array([0, 1, 2, 3, 4, 6]))
    p, kind = rng.random((5, lm.Layer.KINDS)), np.array([0, 3, 3, 1, 7])
    place, valid, scored = lm.windows(t)
    assert scored.sum() == 40 and sorted(place[scored].tolist()) == list(range(40))
    last = slice(lm.WINDOW - lm.STEP, None)
    at, mine = h[np.clip(place[:, last], 0, 39)], scored[:, last]

    def loss(layer):
        z, _ = lm.inputs(t, place, valid, layer.embed(t))
        w, y, _ = layer.forward(z, valid)
        q = p[at].copy()
        q[..., 1] *= np.take_along_axis(y, kind[at][..., None], 2)[..., 0]
        return -np.log((w * q).sum(2) * np.take_along_axis(y, kind[at][..., None], 2)[..., 0])[mine].mean()

    layer = lm.Layer()
    z, words = lm.inputs(t, place, valid, layer.embed_of(t, place))
    grad = layer.gradient(z, valid, mine, p[at], kind[at], words, t)
    for direction in (grad, rng.standard_normal(len(grad)).astype(np.float32)):
        d = direction / np.linalg.norm(direction)
        slope = (loss(lm.Layer(layer.vector + 1e-2 * d)) - loss(lm.Layer(layer.vector - 1e-2 * d))) / 2e-2
        assert slope == pytest.approx(float(grad @ d), rel=0.05, abs=2e-4)


def test_lm_texts_are_grouped_a_few_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(0, 40, 3000)]
    data, bounds = np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(x) for x in parts]))
    centers = rng.random((lm.EXPERTS, lm.langid.BINS)).astype(np.float32)
    want = np.argmax(lm.langid.vectors(lm.langid.counts(data, bounds), np.ones(lm.langid.BINS, np.float32)) @ centers.T, 1)
    most, whole = [], lm.langid.counts
    monkeypatch.setattr(lm.langid, "counts", lambda d, b: most.append(len(b) - 1) or whole(d, b))
    assert (lm.groups_of(data, bounds, centers) == want).all()
    assert max(most) <= 200 and sum(most) == 3000  # rows of 16 KB, however short the texts


def test_lm_trains_in_one_python_worker_a_task(docs, monkeypatch):
    model, counts = lm.fit(docs.where("doc_id > 5"))
    for h in (model.h, model.h[:0]):  # a second one in the same stage would double the memory of an executor
        few = lm.LanguageModel(**{**model.__dict__, "h": h})
        plan = lm._with_rare(docs.select("doc_id", C.byte_texts(docs)), few, counts, 2)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan.split("Join")[0] and ("Join" in plan) == (not len(h))


def test_lm_ids_of_words_met_or_not(monkeypatch):
    with open(lm.VOCABULARY, "rb") as f:
        raw = f.read()
    enc = shards._encoding(raw)
    texts = ["a b a", "", "na\u00efve \u4e2d\u6587 x\u00a0y \u0085 \u00a0 a", "w1 w2 w3 b", "\u2028 a \U0001f600"]
    for kept in (200_000, 4):  # all are kept; what is kept is dropped again and again
        monkeypatch.setattr(lm, "KEPT", kept)
        for _ in range(2):
            for text in texts:
                data = np.frombuffer(text.encode(), np.uint8)
                t = lm.tokens(data, np.array([0, len(data)]), raw)
                got = [t.ids[t.at[i] : t.at[i + 1]].tolist() for i in t.inverse]
                words = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", text.lower().encode())]
                assert got == [*([*enc.encode_ordinary(w), lm.END_OF_WORD] for w in words), [lm.END_OF_TEXT]]


def test_lm_table_holds_what_is_made_of_ids(docs):
    model, _ = lm.fit(docs.where("doc_id > 5"))
    text = b"the cat zqxv sat on jjqqz the mat \xe4\xb8\xad " + b"x" * 300
    data, bounds = np.frombuffer(text + text, np.uint8), np.array([0, len(text), len(text), 2 * len(text)])
    half = lm.LanguageModel(**{**model.__dict__, "h": model.h[::2], "c": model.c[::2], "kind": model.kind[::2], "logs": model.logs[::2], "ids": (few := lm.Tokens(model.h, None, None, model.ids, model.at).some(np.arange(0, len(model.h), 2))).ids, "at": few.at})
    plain = lm.tokens(data, bounds, model.raw)
    for m in (model, half, lm.LanguageModel(**{**model.__dict__, "h": model.h[:0]})):  # all words in it, every second one, none
        t = lm.tokens(data, bounds, model.raw, m)
        assert (t.hash == plain.hash).all() and (t.inverse == plain.inverse).all() and (t.ids == plain.ids).all() and (t.at == plain.at).all()
        assert (m.classes(t) == model.classes(plain)).all() and (m.experts(t) == model.experts(plain)).all()
        assert (m.counts(t) >= 0).sum() == np.isin(t.hash, m.h).sum()


def test_lm_each_place_is_embedded_once():
    rng = np.random.default_rng(5)
    n, size = rng.integers(0, 30, 400), rng.integers(1, 12, 30)
    at = np.append(0, np.cumsum(size))
    t = lm.Tokens(np.arange(30, dtype=np.uint64), n, np.array([0, 1, 17, 60, 400]), rng.integers(0, 50000, at[-1]), at)
    t.ids[at[1::2] - 1] = lm.END_OF_WORD
    place, valid, _ = lm.windows(t)
    layer = lm.Layer()
    want = np.array([layer.parts(layer.vector)[0][t.ids[at[i] : at[i + 1]] % lm.BINS].mean(0) for i in range(30)])
    assert layer.embed(t) == pytest.approx(want, abs=1e-6)
    places = lm.places_of(t, place, valid)
    for a in range(0, len(place), 3):  # rows of one batch after the other, with the STEP places before it
        z = layer.embedded(places[a : a + 4])
        assert len(z) == len(place[a : a + 3]) + 1
        for row, (ps, ok) in enumerate(zip(place[a : a + 3, -lm.STEP :], valid[a : a + 3, -lm.STEP :], strict=True), 1):
            for j, (p, v) in enumerate(zip(ps, ok, strict=True)):
                assert z[row, j] == pytest.approx(want[n[p - 1]] if v and p not in t.bounds else 0 * want[0], abs=1e-6)


def test_lm_softmax_of_large_values():
    x = np.array([[[1.0, 2.0, -1.0], [500.0, 499.0, -500.0]]], np.float32)
    want = np.exp(x.astype(float) - x.max(2, keepdims=True)) / np.exp(x.astype(float) - x.max(2, keepdims=True)).sum(2, keepdims=True)
    assert lm._softmax(x.copy()) == pytest.approx(want, abs=1e-6)
    assert lm._softmax(x[:, :1].copy(), np.array([0, 0, -1e9], np.float32))[0, 0] == pytest.approx([1 / (1 + np.e), np.e / (1 + np.e), 0], abs=1e-6)


def test_quality_base(spark, rows, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")

    def base(t):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(hit), len(w) < 50 or 2 * len(hit) > len(w)

    got = quality.score_quality(docs, labels).collect()
    same([tuple(r)[:7] for r in got], [(d, *base(t)) for d, t, *_ in rows])
    assert not any(r["kept"] and r["base_failed"] for r in got) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality.score_quality(none, labels.limit(0)).count() == 0


def test_language_held_out(spark, docs, rows, none):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95
    odd = langid.apply(docs, langid.fit(docs)).collect()
    assert len(odd) == len(rows) and {r["lang_pred"] for r in odd} <= {"en", "und"}
    assert {r["lang_pred"] for r in langid.apply(docs, langid.fit(none)).collect()} == {"und"}


def test_toxicity_held_out(spark, docs, rows, none):
    at = "/root/testdata/sf0.01"
    got = queries.op9_toxicity(spark, at).where("held_out").join(spark.read.parquet(f"{at}/labels.parquet").where("toxic is not null"), "doc_id").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.9
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.apply(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
    assert toxicity.apply(none, None).count() == 0


def test_toxicity_letters_come_from_all_learning_texts(spark):
    texts = [(i, f"plain text number with filler words {'vile' if i % 2 else 'kind'}") for i in range(40)] + [(100, "ЖЩЪ жщъ zqx zqx a1b"), (101, None), (102, "")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    learn = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = Counter(s[i : i + 3] for _, t in texts for w in (t or "").lower().split() if w.isalpha() for s in [f"  {w} "] for i in range(len(s) - 2))
    assert {r["s"]: r["n"] for r in toxicity.trigrams(learn).collect()} == want
    assert set(toxicity.fit(learn, labels).letters) == set(want)  # the texts without a label count too


def test_restores_obfuscated_words():
    words = ["poison", "awful", "plain", "letter", "season"] * 20
    tri = Counter(s[i : i + 3] for w in words for s in [f"  {w} "] for i in range(len(s) - 2))
    two = Counter()
    for s, n in tri.items():
        two[s[:2]] += n
    letters = {s: np.log((n + 0.1) / (two[s[:2]] + 3)) for s, n in tri.items()}
    for bad, good in (("p0is0n", "poison"), ("p.o.i.s.o.n", "poison"), ("awwwwful", "awful"), ("@wfu1", "awful"), ("letter", "letter")):
        assert toxicity.restore(bad, letters, np.log(1e-4)) == good


PAGE = "<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><ul><li>Home<li>More</ul></nav>{top}<div class=\"ad\">Buy</div><{m}><h1>{a}</h1><p>{b}<br>next <b>bo</b>ld &amp; &lt;x&gt;<p>{c}<form><input>Name</form></{m}><div id='comments'><p>Nice one</div><footer>&copy; us</footer></body></html>"


def test_html(spark):
    pages, want = [], {}
    for i in range(12):
        a, b, c = (f"{x} {i} " + " ".join(f"{x}{i}{j}" for j in range(20)) for x in "abc")
        m = "article" if i % 2 else "div class='body'"
        page = PAGE.format(m=m, a=a, b=b, c=c, top="<p>Notice</p>" if i % 3 == 99 else "").replace("</div class='body'>", "</div>")
        pages.append((i, f"http://{'one' if i % 2 else 'two'}.example.org/{i}", page, "x"))
        want[i] = f"{a} {b} next bold & <x> {c}"
    pages += [(50, None, None, "x"), (51, "::", "", "x"), (52, "http://p.example.org", "<p>bare<p>text", "x"), (53, "http://q.example.org/", "<" * 2000 + "a" + "</p>" * 2000, "x"), (1, pages[1][1], pages[1][2], "x")]
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string, path string").repartition(4)).collect()
    assert len(got) == len(pages)
    for r in got:
        if r["page_id"] in want:
            assert r["text"] == want[r["page_id"]], r["page_id"]
        assert r["n_chars"] == len(r["text"])
    assert {r["page_id"]: r["text"] for r in got if 50 <= r["page_id"] < 53} == {50: "", 51: "", 52: "bare text"}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_deep_and_broken_pages_take_linear_time():
    import time

    start = time.time()
    deep = html.parse("<body>" + "<div>a" * 100_000 + "</div>" * 100_000 + "<p>end</body>")
    assert html.text_of(deep) == "a " * 100_000 + "end"
    html.main_path(html.skeleton(deep))
    assert html.text_of(html.parse("<p>x</p>" + "<a " * 350_000)).startswith("x <a")
    for page in ("<p>x</p>" + '<a "' * 50_001 + ">", "<p>x</p>" + "<script " * 50_000, "<p>x</p>" + "<!--" * 50_000, "<p>x</p>" + "<div '\"" * 50_001 + ">"):
        assert html.text_of(html.parse(page)).startswith("x")
    assert html.text_of(html.parse("<div><p>one</p></span>two<b>th</b>ree</div>")) == "one twothree"
    assert time.time() - start < 20


def test_html_hidden_is_an_attribute_of_its_own():
    for attrs in ('class="overflow-hidden"', 'aria-hidden="false"', 'data-hidden="false"', "title='hidden'", 'data-style="display:none"'):
        assert html.text_of(html.parse(f"<body><div {attrs}><p>Shown text</p></div></body>")).strip() == "Shown text", attrs
    for attrs in ("hidden", 'class="a" HIDDEN', 'hidden=""', "hidden='until-found'", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display: none"'):
        assert html.text_of(html.parse(f"<body><div {attrs}><p>Gone</p></div><p>Left</p></body>")).strip() == "Left", attrs


def test_pipeline_stages(spark, rows, docs, none, sf):
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, none, sf).count() == 0
    near = {r["doc_id"] for r in pipeline.drop_near(spark, docs, sf).select("doc_id").collect()}
    assert near == {c for _, _, c in components(rows, 5, 80)}
    left = pipeline.drop_lines(spark, docs, sf).collect()
    assert {r["doc_id"] for r in left if not (r["text"] or "").strip()} == {d for d, t, *_ in rows if not (t or "").strip()}


def test_pipeline(spark, sf):
    got = pipeline.run(spark, sf).collect()
    assert got and all(r["exact"] for r in got)
