"""Language identification: the nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors.

Character n-grams of the UTF-8 bytes (three and four bytes, ASCII lower-cased) fall into hashed bins. Document frequencies
count all learning rows. Centroids are fitted on at most `sample` rows for each language.

Defined cases: null texts and texts without a letter are `und` with score 0; rows that repeat are answered alike; rows with
null lang or null doc_id teach nothing; without any learning row every text is `und`. A text that lies further than
`reject` from every centroid is marked in column rejected: its lang_pred is still the nearest language, its score is halved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C

BINS = 4096
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    of: list[str]
    #: Cosine distance beyond which a text is like nothing learned.
    reject: float


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts for each text of a block."""
    out = np.zeros((len(bounds) - 1, BINS), np.float32)
    if len(data) < 3:
        return out
    a = C._LOWER[data].astype(np.uint32)
    tri = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    three = ((tri * np.uint32(0x27D4EB2F)) >> np.uint32(21)).astype(np.int16)
    four = (((tri[:-1] ^ (a[3:] * np.uint32(0x165667B1))) * np.uint32(0x2545F491)) >> np.uint32(21)).astype(np.int16)
    for r in range(len(out)):
        lo, hi = bounds[r], bounds[r + 1]
        if hi - lo > 2:
            out[r, : BINS // 2] = np.bincount(three[lo : hi - 2], minlength=BINS // 2)
        if hi - lo > 3:
            out[r, BINS // 2 :] = np.bincount(four[lo : hi - 3], minlength=BINS // 2)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(1e-9, np.sqrt((v * v).sum(1, keepdims=True)))


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    out = total[bounds[1:]] > total[bounds[:-1]]
    for r in np.flatnonzero(~out & (bounds[1:] > bounds[:-1])):
        out[r] = any(c.isalpha() for c in data[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, started from rows spread out by farthest-first choice."""
    centers = [x[0]]
    while len(centers) < min(k, len(x)):
        centers.append(x[np.argmin(np.max(x @ np.stack(centers).T, axis=1))])
    c = np.stack(centers)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(1e-9, np.sqrt((c * c).sum(1, keepdims=True)))
    return c


def fit(learn: DataFrame, sample: int = 640, clusters: int = 3, quantile: float = 0.001) -> LanguageModel | None:
    """learn: doc_id, text, lang. IDF from all its rows; centroids from at most `sample` rows of each language."""
    learn = learn.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), C.byte_texts(learn), F.col("lang").cast("string"))

    def frequencies(batches):
        df, n = np.zeros(BINS, np.int64), 0
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                df, n = df + (counts(data, bounds) > 0).sum(0), n + hi - lo
        if n:
            yield pa.record_batch([pa.array(np.arange(BINS + 1), pa.int32()), pa.array(np.append(df, n), pa.int64())], ["bin", "n"])

    got = learn.mapInArrow(frequencies, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    df = np.zeros(BINS + 1)
    df[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    idf = np.log((1 + df[BINS]) / (1 + df[:BINS])).astype(np.float32) + np.float32(1)

    def rows(batches):
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                v = vectors(counts(data, bounds), idf).astype(np.float16)
                yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), b.column("lang").slice(lo, hi - lo), pa.array([x.tobytes() for x in v], pa.binary())], ["doc_id", "lang", "x"])

    chosen = C.sampled(learn.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct(), F.col("_id"), "_lang", sample)
    t = learn.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "text", "lang").mapInArrow(rows, "doc_id long, lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    lang = np.array(t.column("lang").to_pylist())
    x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in t.column("x")]).astype(np.float32)
    parts = [(one, _kmeans(x[lang == one], clusters)) for one in sorted(set(lang.tolist()))]
    centroids = np.concatenate([c for _, c in parts])
    far = 1 - (x @ centroids.T).max(1)
    return LanguageModel(idf, centroids, [one for one, c in parts for _ in c], float(min(0.98, np.quantile(far, 1 - quantile) + 0.1)))


def apply(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS weights for each centroid

    def rows(batches):
        m = shared.value
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                known = has_letter(data, bounds) if m else np.zeros(hi - lo, bool)
                pred, score, rejected = np.full(hi - lo, "und", object), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                if known.any():
                    cos = vectors(counts(data, bounds), m.idf) @ m.centroids.T
                    best = cos.argmax(1)
                    rejected = known & (1 - cos.max(1) > m.reject)
                    score = np.where(known, np.clip(cos.max(1), 0, 1) * np.where(rejected, 0.5, 1), 0).astype(float)
                    pred[known] = np.array(m.of, object)[best[known]]
                yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), C.byte_texts(docs)).mapInArrow(rows, "doc_id long, lang_pred string, score double, rejected boolean")
