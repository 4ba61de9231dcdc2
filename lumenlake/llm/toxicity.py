"""Toxicity by noisy-channel deobfuscation: Viterbi decoding of character lattices under a character language model, then a
score of the restored text.

A word that is plain letters without a run of three is its own decoding. Any other word, and any run of three or more
single-character words, becomes a lattice: leetspeak characters may stand for letters, separators may vanish, runs may
shrink. The cheapest path under a character trigram model (of the plain words of all learning texts) plus channel costs is its
restoration. Restored words and their beginnings carry weights learned from labels; a logistic regression turns
a text's sum and density of weights into a probability.

Defined cases: null and empty texts are scored like a text without a weighted word; rows that repeat are scored alike;
null labels teach nothing; with no labels of either class every score is 0. Labels are learned from at most `sample` rows of
each class; trigrams are counted over all learning texts, labelled or not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C

#: What a character may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_LEET_COST, _DROP_COST, _SHRINK_COST = 0.5, 0.3, 0.2
_PLAIN = re.compile(r"[^\W\d_]+", re.UNICODE)
_TRIPLE = re.compile(r"(.)\1\1")
PREFIX = range(4, 9)


@dataclass
class ToxicityModel:
    #: log probability of a letter after two others; a word ends with a blank.
    letters: dict[str, float]
    floor: float
    weights: dict[str, float]
    coef: np.ndarray
    bias: float
    cache: dict[bytes, float] = field(default_factory=dict)

    def restore(self, word: str) -> str:
        return restore(word, self.letters, self.floor)


def restore(word: str, letters: dict[str, float], floor: float) -> str:
    """The cheapest letters for a lower-case word: Viterbi over states of the last two letters."""
    if _PLAIN.fullmatch(word) and not _TRIPLE.search(word):
        return word
    word = word.strip(".,;:?\"'()[]{}<>#*%&")
    if _PLAIN.fullmatch(word) and not _TRIPLE.search(word):
        return word
    if not any(c.isalpha() for c in word):
        return word
    best: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
    i = 0
    while i < len(word):
        c, run = word[i], 1
        while i + run < len(word) and word[i + run] == c:
            run += 1
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options = [(c * k, _SHRINK_COST * (run - k)) for k in ({1, 2} if run > 2 else {1, run})]
        for x in LEET.get(c, ""):
            options.append((x, _LEET_COST * run))
            if run > 1:
                options.append((x * 2, _LEET_COST * run))
        if not c.isalpha():
            options.append(("", _DROP_COST * run))
        fresh: dict[str, tuple[float, str]] = {}
        for state, (cost, path) in best.items():
            for put, extra in options:
                s, total = state, cost + extra
                for x in put:
                    total -= letters.get(s + x, floor)
                    s = s[1] + x
                if s not in fresh or total < fresh[s][0]:
                    fresh[s] = (total, path + put)
        best = fresh
        i += run
    return min((cost - letters.get(s + " ", floor), path) for s, (cost, path) in best.items())[1]


def candidates(w: C.Words) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a block and the joined runs of three or more single characters; for every token its index in
    them and its row."""
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    words = [w.at(i) for i in first]
    rows = w.row
    single = np.array([len(x) == 1 or len(x.decode("utf-8", "replace")) == 1 for x in words], bool)[inverse] if len(words) else np.zeros(0, bool)
    if single.sum() > 2:
        edge = np.flatnonzero(np.concatenate([[True], (single[1:] != single[:-1]) | (rows[1:] != rows[:-1])]))
        stop = np.append(edge[1:], len(single))
        known: dict[bytes, int] = {}
        more_i, more_r = [], []
        for a, z in zip(edge, stop, strict=True):
            if single[a] and z - a > 2:
                joined = b"".join(words[j] for j in inverse[a:z])
                more_i.append(known.setdefault(joined, len(words) + len(known)))
                more_r.append(rows[a])
        words += list(known)
        inverse, rows = np.concatenate([inverse, np.array(more_i, np.int64)]), np.concatenate([rows, np.array(more_r, np.int64)])
    return words, inverse, rows


def _forms(word: str) -> list[str]:
    """What carries weights: a whole restored word, and its beginnings."""
    parts = _PLAIN.findall(word)
    return [f for p in parts for f in ("=" + p, *(p[:k] for k in PREFIX if len(p) > k))]


def _weight(m: ToxicityModel, raw: bytes) -> float:
    word = raw.decode("utf-8", "replace").lower()
    return max((m.weights.get(f, 0.0) for f in _forms(m.restore(word))), default=0.0)


def summary(total: np.ndarray, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the regression sees of a text: weight, hits, and each against what its length would bring by chance."""
    n = np.maximum(n, 1)
    return np.stack([np.log1p(total), np.log1p(hits), np.log1p(100 * total / n), np.log1p(1000 * hits / n), np.log1p(n) / 10], 1)


def _score_block(m: ToxicityModel, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    w = C.split(data, bounds)
    words, at, rows = candidates(w)
    cache = m.cache
    if len(cache) > 400_000:
        cache.clear()
    weights = np.empty(len(words))
    for i, x in enumerate(words):
        v = cache.get(x)
        if v is None:
            v = _weight(m, x)
            if len(x) < 40:
                cache[x] = v
        weights[i] = v
    each = weights[at] if len(words) else np.zeros(0)
    return summary(np.bincount(rows, each, minlength=w.rows), np.bincount(rows, each > 0, minlength=w.rows), w.per_row())


def trigrams(learn: DataFrame) -> DataFrame:
    """s, n: the character trigrams of the plain words of all learning texts, a word between two blanks and one."""

    def rows(batches):
        for b in batches:
            for _, _, data, bounds in C.blocks(b.column("text")):
                w = C.split(data, bounds)
                _, first, count = np.unique(w.hash, return_index=True, return_counts=True)
                tri: Counter[str] = Counter()
                for i, k in zip(first.tolist(), count.tolist(), strict=True):
                    word = w.at(i).decode("utf-8", "replace").lower()
                    if _PLAIN.fullmatch(word) and not _TRIPLE.search(word):
                        s = "  " + word + " "
                        for j in range(len(s) - 2):
                            tri[s[j : j + 3]] += k
                yield pa.record_batch([pa.array(list(tri), pa.string()), pa.array(list(tri.values()), pa.int64())], ["s", "n"])

    return learn.select(C.byte_texts(learn)).mapInArrow(rows, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))


def fit(learn: DataFrame, labels: DataFrame, sample: int = 2400) -> ToxicityModel | None:
    """learn: the rows that may teach, doc_id and text. At most `sample` labelled texts of each class reach the driver."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").distinct()
    chosen = C.sampled(marked, F.col("_id"), "toxic", sample)

    def rows(batches):
        for b in batches:
            y = b.column("toxic").to_pylist()
            ids = b.column("doc_id").to_pylist()
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                w = C.split(data, bounds)
                words, at, row = candidates(w)
                order = np.argsort(row, kind="stable")
                first = np.searchsorted(row[order], np.arange(hi - lo + 1))
                out = []
                for r in range(hi - lo):
                    c = Counter(at[order[first[r] : first[r + 1]]].tolist())
                    out.append(b"\n".join(b"%d %b" % (n, words[j]) for j, n in c.items()))
                yield pa.record_batch([pa.array(ids[lo:hi], pa.int64()), pa.array(y[lo:hi], pa.int32()), pa.array(w.per_row(), pa.int64()), pa.array(out, pa.binary())], ["doc_id", "toxic", "n", "words"])

    t = (
        learn.select(F.col("doc_id").cast("long"), C.byte_texts(learn)).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text")
        .mapInArrow(rows, "doc_id long, toxic int, n long, words binary").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    )
    y, n = t.column("toxic").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    bags = []
    for x in t.column("words"):
        bag = []
        for line in x.as_py().split(b"\n") if x.as_py() else []:
            k, _, word = line.partition(b" ")
            bag.append((word.decode("utf-8", "replace").lower(), int(k)))
        bags.append(bag)
    # The character model: of plain words, in all texts alike; its rows are the trigrams of letters that exist.
    found = trigrams(learn.where("doc_id is not null")).toArrow()
    tri = dict(zip(found.column("s").to_pylist(), found.column("n").to_pylist(), strict=True))
    two: Counter[str] = Counter()
    for s, k in tri.items():
        two[s[:2]] += k
    letters = {s: math.log((k + 0.1) / (two[s[:2]] + 3)) for s, k in tri.items()}
    floor = math.log(1e-4)
    cache: dict[str, list[str]] = {}
    toxic_rate, clean_rate, toxic_docs = Counter(), Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        seen: Counter[str] = Counter()
        for word, k in bag:
            forms = cache.get(word)
            if forms is None:
                forms = cache[word] = _forms(restore(word, letters, floor))
            for f in forms:
                seen[f] += k
        # A text counts a form by its share of that text, so long texts do not drown short ones.
        (toxic_rate if label else clean_rate).update(seen)
        if label:
            toxic_docs.update(seen.keys())
    toxic_words, clean_words = n[y == 1].sum() + 1, n[y == 0].sum() + 1
    least = max(3, 0.004 * (y == 1).sum())
    weights = {}
    for f, k in toxic_rate.items():
        if toxic_docs[f] >= least:
            ratio = math.log((k + 0.2) / toxic_words) - math.log((clean_rate[f] + 0.2) / clean_words)
            if ratio > 1.2:
                weights[f] = ratio
    total, hits = np.zeros(len(bags)), np.zeros(len(bags))
    for i, bag in enumerate(bags):
        for word, k in bag:
            v = max((weights.get(f, 0.0) for f in cache[word]), default=0.0)
            total[i] += v * k
            hits[i] += (v > 0) * k
    coef, bias = C.logistic(summary(total, hits, n), y, l2=1e-4, steps=1500, lr=0.05)
    return ToxicityModel(letters, floor, weights, coef, bias)


def apply(docs: DataFrame, model: ToxicityModel | None, keep: list[str] | None = None, score: str = "_score") -> DataFrame:
    """doc_id and score for each row; with keep, those columns of docs instead of doc_id, and the score under a name that is not
    among them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the sample's vocabulary, and the trigrams of letters

    def scores(texts: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for lo, hi, data, bounds in C.blocks(texts):
            out.append(np.zeros(hi - lo) if m is None else 1 / (1 + np.exp(-np.clip(_score_block(m, data, bounds) @ m.coef + m.bias, -40, 40))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    def rows(batches):
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), scores(b.column("text"))], ["doc_id", "score"])

    def whole(batches):
        for b in batches:
            yield pa.record_batch([*b.columns[:-1], scores(b.columns[-1])], [*keep, score])

    if keep is None:
        return docs.select(F.col("doc_id").cast("long"), C.byte_texts(docs)).mapInArrow(rows, "doc_id long, score double")
    from pyspark.sql import types as T

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(score, T.DoubleType())])
    return docs.select(*keep, docs["text"].cast("binary").alias(C.fresh("_bytes", docs))).mapInArrow(whole, schema)
