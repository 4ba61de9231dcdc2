"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long text has a Jaccard similarity near zero, so a text's own MinHash signature cannot find it. The
side that is signed is therefore the item: items are partitioned by their number of shingles, and the sketch of an item is
the smallest m of its shingle hashes, m growing with its partition's size so that any text that holds the needed share of
the item must hold one of them (of s shingles at most s - ceil(c s) may be missing). All shingles of all texts are probed
against two bitmaps of fixed size, of the sketches and of all item shingles; what is in neither is read once and forgotten.
Only shingles of sketches are joined with the items, which gives the candidate pairs; then the other shingles of these pairs are
looked up and the share of the item's distinct shingles in the text is counted exactly. A phrase of many items in many texts
that is in no sketch meets nothing. No pair at or above the threshold is lost.

Words are maximal runs of letters and digits, lower-cased, so punctuation and line breaks do not matter.

Defined cases: null or wordless texts and items match nothing; an item of fewer than k words is one shingle of all its
words, sought at that length; repeated items are answered each; rows that share a doc_id are measured each by itself and answered by
the one that holds most of an item; an empty benchmark gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C

#: Bytes that part words: ASCII except letters and digits. Bytes of other scripts belong to words.
PARTS = bytes(c for c in range(128) if not chr(c).isalnum())
#: The bitmap of item shingles has 2**BITS bits (8 MB) whatever the benchmark's size.
BITS = 26


def _windows(w: C.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the windows of exactly k words."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = C.mix(acc * np.uint64(0xD6E8FEB86659FD93) + w.hash[j : j + len(acc)])
    keep = w.row[: len(acc)] == w.row[k - 1 :]
    return acc[keep], w.row[: len(acc)][keep]


def item_shingles(items: DataFrame, k: int, containment: float) -> DataFrame:
    """_item, h, size, words, sketched for each distinct shingle of each item."""

    def rows(batches):
        for b in batches:
            ids = b.column("_item").to_numpy()
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                w = C.split(data, bounds, space=PARTS)
                count = w.per_row()
                hashes, row = _windows(w, k)
                for n in range(1, k):
                    h, r = _windows(w, n)
                    short = count[r] == n
                    hashes, row = np.concatenate([hashes, h[short]]), np.concatenate([row, r[short]])
                h, at = C.distinct(hashes, row, hi - lo)
                size = np.diff(at)
                if not len(h):
                    continue
                of = np.repeat(np.arange(hi - lo), size)
                # The partition of an item is the power of two at or above its size; its sketch serves all sizes in it.
                top = np.where(size > 0, 2 ** np.ceil(np.log2(np.maximum(size, 1))), 0)
                m = np.maximum(1, np.floor(top * (1 - containment) + 1e-9) + 1)
                rank = np.arange(len(h)) - at[of]
                yield pa.record_batch([pa.array(ids[lo:hi][of]), pa.array(h.view(np.int64)), pa.array(size[of]), pa.array(np.minimum(count[of], k).astype(np.int32)), pa.array(rank < m[of])], ["_item", "h", "size", "words", "sketched"])

    return items.select(F.col("item_id").cast("long").alias("_item"), C.byte_texts(items)).where("_item is not null").mapInArrow(rows, "_item long, h long, size long, words int, sketched boolean")


def _bitmap(shingle: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The item side as a bitmap of fixed size, put together from each task's set bits, and the shingle lengths in use."""

    def rows(batches):
        bits, lengths = np.zeros(1 << (BITS - 3), np.uint8), set()
        for b in batches:
            _set(bits, b.column("h").to_numpy().view(np.uint64))
            lengths |= set(b.column("words").to_pylist())
        if lengths:
            used = np.flatnonzero(bits)
            yield pa.record_batch([pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([bits[used].tobytes()], pa.binary()), pa.array([sorted(lengths)], pa.list_(pa.int32()))], ["at", "bits", "lengths"])

    out, lengths = np.zeros(1 << (BITS - 3), np.uint8), set()
    for r in shingle.coalesce(8).mapInArrow(rows, "at binary, bits binary, lengths array<int>").toArrow().to_pylist():  # at most 8 bitmaps, made side by side
        out[np.frombuffer(r["at"], np.int32)] |= np.frombuffer(r["bits"], np.uint8)
        lengths |= set(r["lengths"])
    return out, sorted(lengths)


def _set(bits: np.ndarray, h: np.ndarray) -> None:
    at = h >> np.uint64(64 - BITS)
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def contained(docs: DataFrame, items: DataFrame, k: int = 5, containment: float = 0.8, by_text: bool = False) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared, containment of every pair at or above the threshold. With by_text a row
    for each text of a doc_id that holds an item, with text_hash, its xxhash64."""
    shingle = C.stored(item_shingles(items, k, containment), "items")
    bits, lengths = _bitmap(shingle)
    sketch = shingle.where("sketched")
    shared = docs.sparkSession.sparkContext.broadcast((bits, _bitmap(sketch)[0], lengths))

    def rows(batches):
        bits, sketched, lengths = shared.value
        for b in batches:
            ids, texts = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("_text").to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                w = C.split(data, bounds, space=PARTS)
                hs, rs = [], []
                for n in lengths:
                    h, r = _windows(w, n)
                    hit = _in(bits, h)
                    hs.append(h[hit])
                    rs.append(r[hit])
                if hs and sum(map(len, hs)):
                    h, at = C.distinct(np.concatenate(hs), np.concatenate(rs), hi - lo)
                    yield pa.record_batch([pa.array(np.repeat(ids[lo:hi], np.diff(at)), pa.int64()), pa.array(np.repeat(texts[lo:hi], np.diff(at)), pa.int64()), pa.array(h.view(np.int64)), pa.array(_in(sketched, h))], ["doc_id", "_text", "h", "probe"])

    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("_text"), C.byte_texts(docs)).where("doc_id is not null").mapInArrow(rows, "doc_id long, _text long, h long, probe boolean")
    found = C.stored(found, "found")
    candidates = found.where("probe").join(sketch.select("h", "_item"), "h").select("doc_id", "_text", "_item").distinct()
    wanted = candidates.join(shingle.select("_item", "h", "size"), "_item")
    pairs = wanted.join(found.select("doc_id", "_text", "h").distinct(), ["doc_id", "_text", "h"]).groupBy("doc_id", "_text", "_item").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("n_shingles"))
    least = F.ceil(F.col("n_shingles") * F.lit(containment) - 1e-9)
    repeats = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("_item")).count().where("count > 1")
    if not repeats.isEmpty():  # rows that share an item_id would add up
        pairs = pairs.join(repeats, "_item", "left").withColumn("n", F.least("n", "n_shingles")).drop("count")
    per = ["doc_id", *(["_text"] if by_text else []), "_item"]
    best = pairs.where(F.col("n") >= least).groupBy(*per).agg(F.max("n").alias("n"), F.max("n_shingles").alias("n_shingles"))
    return best.select("doc_id", *([F.col("_text").alias("text_hash")] if by_text else []), F.col("_item").alias("item_id"), "n_shingles", F.col("n").alias("n_shared"), (F.col("n") / F.col("n_shingles")).alias("containment"))
