"""A vector index with exact answers: an inverted file of cells around centroids, read only where the triangle inequality
leaves a chance.

A row lies in the cell of its nearest centroid, and in a ring of that cell by its distance (the chord between directions) from
it. A search of some radius reads the rings that meet the shell around a centroid in which its answers must lie; the rings it
skips hold none. Rings lie together in shares of at most `piece` rows, and larger ones are dealt to several, so that a share and a
batch of questions is all that a task holds, however many rows are alike. A question's vector goes to each share once and a row's
to each part of the questions, so what is shuffled grows with the shares and not with the rings.

Distances are cosine distances rounded to six places. A vector that is null, has a null, NaN or infinite part, has no length or
not the index's number of dimensions is near to nothing. Keys are whole numbers; rows with a null key are left out, rows that
repeat are found each. An index of no rows answers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.operators.groups import written
from lumenlake.operators.search import cosine_distance

#: Vectors that centroids are fitted on, at most; only how much is skipped depends on them, never an answer.
SAMPLE = 4096
CELLS, RING, PIECE = 64, 0.05, 65_536
#: Shares that an index has at least, if they have so many rows; numbers that a share's vectors have at most; tasks of a search.
SHARES, LEAST, VALUES, TASKS = 8, 512, 1 << 22, 64
#: Rows of small rings that meet a batch of questions together.
BLOCK = 1024
#: What rounding of distances and of bounds may hide.
SLACK = 1e-6


def directions(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists that have a direction in so many dimensions, and their unit vectors."""
    if not dims:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    fits = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == dims
    x = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(all="ignore"):
        size = np.sqrt((x * x).sum(1))
        good = np.isfinite(size) & (size > 0)
    return np.flatnonzero(fits)[good], x[good] / size[good, None]


def fitted(rows: DataFrame, key: str, vector: str, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centroids by spherical k-means on at most `sample` vectors that have a direction, those of the smallest hash of the key;
    as many dimensions as most of these have."""
    size = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = rows.where((size > 0) & (size < float("inf")))  # a null part makes the sum null, a NaN is above infinity
    some = usable.orderBy(F.xxhash64(key, vector)).select(vector).limit(sample).toArrow().column(0).combine_chunks()
    if not len(some):
        return np.zeros((0, 0))
    sizes, n = np.unique(pc.list_value_length(some).to_numpy(zero_copy_only=False), return_counts=True)
    _, x = directions(some, int(sizes[np.argmax(n)]))
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(0).permutation(len(c))[:cells]]
    for _ in range(6):
        of = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


@dataclass
class Index:
    """A written table of key, vector and further columns with cell, ring, off (distance from the centroid) and salt; the
    centroids; and the rings (cell, ring, n, lo, hi), of which there are at most cells times 2 / RING."""

    table: DataFrame
    key: str
    vector: str
    centroids: np.ndarray
    rings: pd.DataFrame
    piece: int

    def dealt(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The first share of each ring, the number of shares it is dealt to (1 for all but rings larger than a share), and the
        number of shares: runs of rings of about as many rows each, of which none has more than a share may have."""
        n = self.rings["n"].to_numpy(np.int64)
        fits = max(1, min(self.piece, VALUES // max(1, self.centroids.shape[1])))
        size = min(fits, max(LEAST, -(-int(n.sum()) // SHARES)))
        first, pieces, share, full = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), 0, 0
        for r, rows in enumerate(n.tolist()):
            if full and full + rows > size:
                share, full = share + 1, 0
            first[r], pieces[r] = share, max(1, -(-rows // size))
            share, full = (share + int(pieces[r]), 0) if rows > size else (share, full + rows)
        return first, pieces, share + (full > 0)

    def shells(self, units: np.ndarray, radius: float) -> np.ndarray:
        """For each unit vector and ring, whether a row of the ring can lie within the radius."""
        reach = np.sqrt(2 * (min(max(radius, 0.0), 2.0) + SLACK)) + SLACK
        far = np.sqrt(np.maximum(0, 2 - 2 * units @ self.centroids.T))
        cell = self.rings["cell"].to_numpy(np.int64)
        d = far[:, cell]
        near = (d - reach <= self.rings["hi"].to_numpy()) & (d + reach >= self.rings["lo"].to_numpy())
        return near & (d <= far.min(1, keepdims=True) + 2 * reach)  # beyond that, another centroid is nearer to all that is within reach


class _Held:
    """The rows of a share in the order of their rings, for questions that pass by."""

    def __init__(self, index: Index, got: list[tuple[np.ndarray, ...]]) -> None:
        keys, cell, ring, units = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((ring, cell))
        self.keys, self.units = keys[order], units[order]
        code = cell[order].astype(np.int64) << 32 | ring[order]
        self.short = self.units.astype(np.float32)
        self.bounds = np.concatenate([np.flatnonzero(np.diff(code, prepend=-1)), [len(code)]])
        # small rings are looked at together, BLOCK rows or one ring at least
        self.blocks = [0]
        for r in range(1, len(self.bounds)):
            if r == len(self.bounds) - 1 or self.bounds[r + 1] - self.bounds[self.blocks[-1]] > BLOCK:
                self.blocks.append(r)
        known = index.rings["cell"].to_numpy(np.int64) << 32 | index.rings["ring"].to_numpy(np.int64)
        self.index = Index(None, index.key, index.vector, index.centroids, index.rings.iloc[np.searchsorted(known, code[self.bounds[:-1]])], index.piece)

    def nearest(self, k: np.ndarray, u: np.ndarray, radius: float, most: int | None, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of questions, keys found and distances; one lot if `most` is asked for, else several."""
        near, limit = np.logical_or.reduceat(self.index.shells(u, radius), self.blocks[:-1], axis=1), np.full(len(k), float(radius))
        kept, short, slack = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), u.astype(np.float32), SLACK + 1.3e-7 * u.shape[1]
        for r in np.flatnonzero(near.any(0)).tolist():
            lo, hi, of = self.bounds[self.blocks[r]], self.bounds[self.blocks[r + 1]], np.flatnonzero(near[:, r])
            for a in range(lo, hi, 4096):  # by short numbers first; what they leave is measured in full
                dots = short[of] @ self.short[a : min(a + 4096, hi)].T
                q, f = np.nonzero(dots >= (1 - slack - limit[of]).astype(np.float32)[:, None])
                if not len(q):
                    continue
                q, f = of[q], a + f
                d = np.concatenate([np.round(1 - np.einsum("ij,ij->i", u[q[i : i + 65536]], self.units[f[i : i + 65536]]), 6) for i in range(0, len(q), 65536)]) + 0.0  # no negative zero
                f = self.keys[f]
                hit = d <= limit[q]
                if not itself:
                    hit &= k[q] != f
                q, f, d = q[hit], f[hit], d[hit]
                if most is None:
                    yield q, f, d
                    continue
                q, f, d = (np.concatenate(x) for x in zip(kept, (q, f, d), strict=True))
                order = np.lexsort((f, d, q))
                q, f, d = q[order], f[order], d[order]
                ok = np.arange(len(q)) - np.searchsorted(q, q) < most
                q, f, d = kept = q[ok], f[ok], d[ok]
                last = np.searchsorted(q, np.arange(len(k))) + most - 1
                full = (last < len(q)) & (q[np.minimum(last, len(q) - 1)] == np.arange(len(k))) if len(q) else np.zeros(len(k), bool)
                limit[full] = d[last[full]]
        if most is not None:
            yield kept


def build(rows: DataFrame, key: str, vector: str, cells: int = CELLS, piece: int = PIECE, keep: Sequence[str] = ()) -> Index:
    """An index of all rows with a direction; columns of `keep` go with them and can be asked for by a condition."""
    centroids = fitted(rows.where(F.col(key).isNotNull()), key, vector, cells)
    dims = centroids.shape[1]
    read = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), vector, *keep)
    names = [key, vector, *keep, "cell", "ring", "off"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows if len(centroids) else 0, 4096):
                part = b.slice(lo, 4096)
                at, u = directions(part.column(vector), dims)
                dots = u @ centroids.T
                cell = np.argmax(dots, 1) if len(at) else np.zeros(0, np.int64)
                off = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(at)), cell]))
                part = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array((off / RING).astype(np.int32)), pa.array(off)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields)
    table = written(read.mapInArrow(placed, f"{kinds}, cell int, ring int, off double").withColumn("salt", F.monotonically_increasing_id()))
    rings = table.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("off").alias("lo"), F.max("off").alias("hi")).orderBy("cell", "ring").toPandas()
    return Index(table, key, vector, centroids, rings, piece)


def near(index: Index, vector: Sequence[float], radius: float, most: int | None = None, where: Column | None = None) -> tuple[DataFrame, int]:
    """(key, distance of the `most` rows nearest to one vector and within the radius; the number of rings read of len(index.rings)).
    The scan is told which cells and distances from the centroids to read."""
    at, u = directions(pa.array([[float(v) for v in vector]], pa.list_(pa.float64())), index.centroids.shape[1])
    open_ = index.rings[index.shells(u, radius)[0]] if len(at) and len(index.rings) else index.rings[:0]
    rows = index.table.where(F.lit(False))
    if len(open_):
        each = [(F.col("cell") == int(c)) & F.col("ring").isin([int(r) for r in g["ring"]]) for c, g in open_.groupby("cell")]
        chance = each[0]
        for e in each[1:]:
            chance = chance | e
        rows = index.table.where(F.col("cell").isin(sorted({int(c) for c in open_["cell"]})) & chance)
    rows = rows if where is None else rows.where(where)
    d = rows.select(index.key, F.round(cosine_distance(F.col(index.vector), vector), 6).alias("distance")).where(F.col("distance") <= radius)
    return (d if most is None else d.orderBy("distance", index.key).limit(most)), len(open_)


def neighbours(index: Index, questions: DataFrame, key: str, vector: str, radius: float, most: int | None = None, itself: bool = True, where: Column | None = None) -> DataFrame:
    """question, found, distance: of each row of questions, the rows of the index within the radius (where a condition on kept
    columns holds), the `most` nearest if asked for; ties go to the smallest key. Without itself, equal keys do not meet.

    Questions go to the shares that hold a ring in which an answer may lie, once to each; the questions of a share are dealt to
    parts. A task holds a share and passes the questions of a part by in batches, each by the rings that it needs; with `most`,
    no share answers more than that, and what is farther than the `most` found so far is not looked at again."""
    spark, dims, rings = questions.sparkSession, index.centroids.shape[1], index.rings
    first, pieces, shares = index.dealt()
    parts = max(1, -(-TASKS // max(1, shares)))
    holds = np.zeros((len(rings), shares), np.float32)  # which shares have rows of a ring
    for r, (f, n) in enumerate(zip(first.tolist(), pieces.tolist(), strict=True)):
        holds[r, f : f + n] = 1
    bare = Index(None, index.key, index.vector, index.centroids, rings, index.piece)  # what tasks need of it
    float_ = "array<float>" if {index.table.schema[index.vector].dataType.simpleString(), questions.schema[vector].dataType.simpleString()} == {"array<float>"} else "array<double>"
    sent = pa.list_(pa.float32() if float_ == "array<float>" else pa.float64())

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows if len(rings) else 0, 256):
                block = b.slice(lo, 256)
                at, u = directions(block.column(1), dims)
                q, share = np.nonzero(bare.shells(u, radius).astype(np.float32) @ holds) if len(at) else (np.zeros(0, np.int64),) * 2
                for some in range(0, len(q), 4096):  # a question's vector is sent to each of its shares
                    s = slice(some, some + 4096)
                    got = block.take(pa.array(at[q[s]]))
                    part = (got.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)
                    blank = pa.array(np.full(len(got), -1, np.int32))
                    yield pa.RecordBatch.from_arrays([got.column(0), got.column(1).cast(sent), blank, blank, pa.array(share[s].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(got), np.int8))], ["k", "v", "cell", "ring", "share", "part", "asks"])

    shape = f"k bigint, v {float_}, cell int, ring int, share int, part int, asks tinyint"
    rows = index.table if where is None else index.table.where(where)
    number = spark.createDataFrame(pd.DataFrame({"cell": rings["cell"].to_numpy(np.int32), "ring": rings["ring"].to_numpy(np.int32), "_f": first, "_n": pieces}), "cell int, ring int, _f bigint, _n bigint")
    held = rows.join(F.broadcast(number), ["cell", "ring"]).select(
        F.col(index.key).alias("k"), F.col(index.vector).cast(float_).alias("v"), "cell", "ring", (F.col("_f") + F.pmod("salt", "_n")).cast("int").alias("share"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).cast("tinyint").alias("asks"),
    )
    asks = questions.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast(float_).alias("v"))
    asks = asks.mapInArrow(asked, shape)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got, held_ = None, [], None
        for b in batches:
            place = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("share", "part", "asks")])
            edges = np.concatenate([[0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1, [b.num_rows]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                where = tuple(place[:2, lo].tolist())
                if where != now:
                    now, got, held_ = where, [], None
                at, u = directions(b.column("v").slice(lo, hi - lo), dims)
                k, cell, ring = (b.column(c).slice(lo, hi - lo).to_numpy()[at] for c in ("k", "cell", "ring"))
                if not place[2, lo]:
                    got.append((k, cell, ring, u))
                    continue
                if not got:
                    continue
                if held_ is None:
                    held_, got = _Held(bare, got), got[:1]  # what came is copied once, in the order of its rings
                for s in range(0, len(k), 256):
                    for q, found, d in held_.nearest(k[s : s + 256], u[s : s + 256], radius, most, itself):
                        yield pa.RecordBatch.from_arrays([pa.array(k[s : s + 256][q]), pa.array(found), pa.array(d)], ["question", "found", "distance"])

    at = ["share", "part"]
    pairs = held.unionByName(asks).repartition(*at).sortWithinPartitions(*at, "asks").mapInArrow(answered, "question bigint, found bigint, distance double")
    if most is None:
        return pairs
    rank = F.row_number().over(W.partitionBy("question").orderBy("distance", "found"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")
