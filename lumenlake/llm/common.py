"""Helpers that the operators share: whole-text tokenising in numpy, bounded samples, and tables that cut lineage.

Texts travel to Python as Arrow binary columns. A batch is worked on in blocks of a few megabytes, so the memory of a
task follows the longest text and not the batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: a space, and the code points 9 to 13.
ASCII_SPACE = bytes([0x20, 9, 10, 11, 12, 13])
BLOCK_BYTES = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.zeros(0, np.uint64)


def _multipliers(n: int) -> np.ndarray:
    """The first n outputs of the splitmix64 generator, made odd: the multiplier of each byte position in a word."""
    global _ODD
    if len(_ODD) < n:
        z = np.arange(1, max(n, 256) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _ODD = mix(z) | np.uint64(1)
    return _ODD[:n]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


@dataclass
class Words:
    """The words of a block of texts: byte spans in data, the row of each, and a 64-bit hash of each."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def at(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def fresh(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no column of the frames is called so (case does not tell names apart in Spark)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last, bytes, bounds of each row in them) of runs of rows of about size bytes; null is empty."""
    texts = texts.fill_null(b"") if texts.null_count else texts
    large = pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split(data: np.ndarray, bounds: np.ndarray, lower: bool = True, space: bytes = ASCII_SPACE, lead: bool = False) -> Words:
    """Words are the longest runs without a space byte. With lead, the white space before a word belongs to it, and that
    at a text's end is a word of its own."""
    if lower:
        data = _LOWER[data]
    if not len(data):
        return Words(data, bounds, *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    solid = ~_table(space)[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    before[inner] = False
    first = solid & ~before
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    start, end = np.flatnonzero(first), np.flatnonzero(solid & ~after) + 1
    if lead:
        row = np.searchsorted(bounds, start, "right") - 1
        previous = np.concatenate([[0], end[:-1]])
        fresh = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        opened = np.where(fresh, bounds[row], previous)
        tails = np.zeros(len(bounds) - 1, np.int64) + bounds[:-1]
        if len(row):
            last = np.flatnonzero(np.concatenate([row[1:] != row[:-1], [True]]))
            tails[row[last]] = end[last]
        loose = np.flatnonzero(tails < bounds[1:])
        start, end = np.concatenate([opened, tails[loose]]), np.concatenate([end, bounds[1:][loose]])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        solid = np.ones(len(data), bool)
    row = np.searchsorted(bounds, start, "right") - 1
    length = end - start
    if not len(start):
        return Words(data, bounds, start, end, row, np.zeros(0, np.uint64))
    gap = np.ones(len(data), np.int32)  # position in the word, by a running sum that starts again at each word
    gap[0] = -start[0]
    gap[start[0]] = 0 if start[0] else gap[0]
    gap[start[1:]] = 1 - np.diff(start)
    at = np.cumsum(gap, dtype=np.int32)
    at[: start[0]] = 0
    wide = data.astype(np.uint64) + np.uint64(1)
    wide *= _multipliers(int(max(length.max(), np.diff(np.append(start, len(data))).max())) + 1)[at]
    if not lead:
        wide *= solid
    hashed = mix(np.add.reduceat(wide, start) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Words(data, bounds, start, end, row, hashed)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each window of k words within a text; of a shorter text with a word, that of all its words."""
    n, count = len(w.hash), w.per_row()
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + w.hash[j : j + len(acc)])
    keep = w.row[: len(acc)] == w.row[k - 1 :] if len(acc) else np.zeros(0, bool)
    hashes, rows = acc[keep], w.row[: len(acc)][keep]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        firsts = np.searchsorted(w.row, short)
        extra = np.array([_whole(w.hash[f : f + count[r]]) for f, r in zip(firsts, short, strict=True)], np.uint64)
        hashes, rows = np.concatenate([hashes, extra]), np.concatenate([rows, short])
    return hashes, rows


def _whole(h: np.ndarray) -> np.uint64:
    acc = np.full(1, len(h), np.uint64)
    for x in h:
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + x)
    return acc[0]


def distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted, one row after the other; and the bounds of each row in them."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))])


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists without a Python loop."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def byte_texts(docs: DataFrame, text: str = "text") -> Column:
    return docs[text].cast("string").cast("binary").alias(text)


def fold(column: Column, n: int) -> Column:
    """crc32 of a number written as text, modulo n; null where it is null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines of a cluster see. Where it is unset, a temporary one in local
    mode; on a cluster an error, for a machine's own folder would lose data."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="lumenlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as a table in the shared folder and read again: it cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the bitmap of semi(), whatever the number of keys.
SEMI_BITS = 24


def _spots(keys: pa.Array) -> np.ndarray:
    return (mix(keys.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - SEMI_BITS)).astype(np.int64)


def semi(df: DataFrame, key: str, want: DataFrame, of: str) -> DataFrame:
    """df without most of the rows whose key (a long without nulls in want) is not in want: a bitmap of fixed size is sent to
    the tasks ahead of a join, so that texts which will not match are not shuffled. The join still decides."""

    def marks(batches):
        bits = np.zeros(1 << SEMI_BITS, bool)
        for b in batches:
            bits[_spots(b.column(0))] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(1 << (SEMI_BITS - 3), np.uint8)
    for x in want.select(of).coalesce(8).mapInArrow(marks, "bits binary").toArrow().column("bits"):  # at most 8, of fixed size
        bits |= np.frombuffer(x.as_py(), np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def rows(batches):
        bits = shared.value
        for b in batches:
            b = b.filter(b.column(key).is_valid())
            at = _spots(b.column(key))
            yield b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    return df.mapInArrow(rows, df.schema)


def spans(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans that begin at start and cover data without gaps."""
    length = np.diff(np.append(start, len(data)))
    at = np.arange(len(data)) - np.repeat(start, length)
    wide = (data.astype(np.uint64) + np.uint64(1)) * _multipliers(int(length.max(initial=0)) + 1)[at]
    return mix(np.add.reduceat(wide, start) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(start) else np.zeros(0, np.uint64)


def sampled(df: DataFrame, key: Column, per: str, most: int, salts: int = 32) -> DataFrame:
    """At most `most` rows for each value of column per, chosen by a hash of key; dealt over salts, so no value meets in
    one task. For fitting models only: its bound is a parameter of each operator that calls it."""
    from pyspark.sql import Window

    h = F.xxhash64(key)
    rank = F.row_number().over(Window.partitionBy(per, F.pmod(h, F.lit(salts))).orderBy(h, key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= max(1, most // salts)).drop("_rank")


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300, lr: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression with balanced classes by Adam on all rows at once; (weights, bias)."""
    w, b = np.zeros(x.shape[1]), 0.0
    m = v = np.zeros(x.shape[1] + 1)
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, steps + 1):
        g = cost * (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y)
        grad = np.append(x.T @ g + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b
