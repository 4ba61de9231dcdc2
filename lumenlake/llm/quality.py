"""Quality rules: base rules, and a hashed word and character n-gram logistic regression with calibrated probability.

The classifier is fitted on at most `sample` labelled rows of each class (a bounded sample of hashed features goes to the
driver); every row is scored, in Arrow batches.

Defined cases: null and empty text have no words, fail the base rules and are not kept; rows that repeat are scored alike
and all returned; null labels and labels without a document teach nothing; with no labels of either class the verdict is
"kept" unless a base rule fails; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C

#: Hashed features: words first, then character trigrams.
WORD_BINS, CHAR_BINS = 2048, 2048
DIM = WORD_BINS + CHAR_BINS
SYMBOLS = b"#*$%&|<>"
_SYMBOL = C._table(SYMBOLS)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    #: Platt's scaling of the raw margin.
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (x @ self.weights + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(data: np.ndarray, w: C.Words) -> np.ndarray:
    """A row of unit-length square-rooted frequencies for each text, words and trigrams each on their own."""
    n = w.rows
    out = np.zeros((n, DIM), np.float32)
    word_bin = (w.hash >> np.uint64(40)).astype(np.int64) % WORD_BINS
    if len(data) > 2:
        a = data.astype(np.uint32)
        tri = ((a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
        char_bin = (tri >> np.uint32(21)).astype(np.int16)
    first = np.searchsorted(w.row, np.arange(n + 1))
    for r in range(n):
        out[r, :WORD_BINS] = np.bincount(word_bin[first[r] : first[r + 1]], minlength=WORD_BINS)
        if (hi := w.bounds[r + 1] - 2) > w.bounds[r]:
            out[r, WORD_BINS:] = np.bincount(char_bin[w.bounds[r] : hi], minlength=CHAR_BINS)
    np.sqrt(out, out=out)
    for part in (slice(0, WORD_BINS), slice(WORD_BINS, DIM)):
        out[:, part] /= np.maximum(1e-9, np.sqrt((out[:, part] ** 2).sum(1, keepdims=True)))
    return out


def base(data: np.ndarray, w: C.Words) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text of a block."""
    n = w.rows
    solid = ~C._table(C.ASCII_SPACE)[data]
    points = solid & ((data & 0xC0) != 0x80)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[w.bounds[1:]] - total[w.bounds[:-1]]

    out = {"n_words": w.per_row(), "word_chars": per_row(points), "n_symbols": per_row(_SYMBOL[data]), "n_dup_lines": np.zeros(n, np.int64), "n_repeat_words": np.zeros(n, np.int64)}
    h = w.hash
    if len(h) > 2:
        tri = C.mix(C.mix(C.mix(h[:-2]) * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])
        whole = w.row[:-2] == w.row[2:]
        start, rows, tri = np.flatnonzero(whole), w.row[:-2][whole], tri[whole]
        order = np.lexsort((tri, rows))
        same = (tri[order][1:] == tri[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(h) + 2, bool)
        at = start[order[twice]]
        for j in range(3):
            covered[at + j] = True
        out["n_repeat_words"] = np.bincount(w.row[covered[: len(h)]], minlength=n)
    for r in range(n):
        lines = data[w.bounds[r] : w.bounds[r + 1]].tobytes().split(b"\n")
        if len(lines) > 1:
            seen: set[bytes] = set()
            again = 0
            for line in lines:
                if line in seen:
                    again += 1
                elif line.strip(C.ASCII_SPACE):
                    seen.add(line)
            out["n_dup_lines"][r] = again
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1200) -> QualityModel | None:
    """Learns quality = 1 from at most `sample` rows of each label; a quarter of them calibrates the probability."""
    chosen = C.sampled(labels.select(F.col("doc_id").alias("_id"), "quality").where("quality in (0, 1) and doc_id is not null").distinct(), F.col("_id"), "quality", sample)

    def rows(batches):
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                x = features(data, C.split(data, bounds, lower=False)).astype(np.float16)
                yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), b.column("quality").slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "quality", "x"])

    joined = docs.select(F.col("doc_id").cast("long"), C.byte_texts(docs)).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    got = joined.mapInArrow(rows, "doc_id long, quality int, x binary").toArrow()
    y = got.column("quality").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in got.column("x")]).astype(np.float32)
    order = np.lexsort((y, got.column("doc_id").to_numpy()))
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    w, b = C.logistic(x[~held], y[~held])
    check = held if held.any() else ~held
    slope, shift = C.logistic((x[check] @ w + b)[:, None], y[check], l2=0)
    return QualityModel(w.astype(np.float32), b, float(slope[0]) if slope[0] > 0 else 1.0, float(shift) if slope[0] > 0 else 0.0)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_score double"


def apply(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """One row for each document: the base counts, whether a base rule fails, the score and the verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights

    def rows(batches):
        m = shared.value
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                w = C.split(data, bounds, lower=False)
                c = base(data, w)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                p = m.probability(features(data, w)).astype(float) if m else np.ones(hi - lo)
                yield pa.record_batch(
                    [b.column("doc_id").slice(lo, hi - lo), *(pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & (p >= (m.threshold if m else 0))), pa.array(p)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score"],
                )

    return docs.select(F.col("doc_id").cast("long"), C.byte_texts(docs)).mapInArrow(rows, SCHEMA)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 1200) -> DataFrame:
    return apply(docs, fit(docs, labels, sample))
