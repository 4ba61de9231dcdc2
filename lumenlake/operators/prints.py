"""Pictures reduced to grey values: which frames of a video show something new, and prints by which pictures are alike.

Grey values come as bytes, row by row. Rows without grey values, a key or (for frames) a time are left out; rows that repeat
are looked at each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edge of a picture that is printed, frequencies kept each way, the difference that is a change.
SIZE, LOW, CHANGE = 32, 8, 6.0
#: Widths of the parts that prints of 64 bits are cut into: of two that differ in four bits at most, two parts are equal, or one
#: is and each other one differs in one bit.
WIDTHS = (13, 13, 13, 13, 12)
_COSINES = np.cos(np.pi / (2 * SIZE) * np.outer(np.arange(LOW), 2 * np.arange(SIZE) + 1))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the bounds of each row in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def changed(frames: DataFrame, medium: str, second: str, grey: str, threshold: float = CHANGE, max_gap: int | None = None) -> DataFrame:
    """medium, second, difference of the frames that are kept: a medium's first (difference null), then each whose mean absolute
    difference from the last that was kept is `threshold` or more, or that comes max_gap seconds or more after it.

    Grey values of other lengths, and empty ones, differ by 255. Frames stream by in the order of their time; a task holds the
    last one that was kept and a batch, however long a video is. Frames of one time are taken in the order of their bytes."""
    read = frames.where(F.col(medium).isNotNull() & F.col(second).isNotNull() & F.col(grey).isNotNull())
    read = read.select(F.col(medium).alias("m"), F.col(second).cast("bigint").alias("s"), F.col(grey).cast("binary").alias("g"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, since = None, None, 0
        for b in batches:
            data, bounds = _bytes(b.column("g"))
            size, times = np.diff(bounds), b.column("s").to_numpy()
            code = b.column("m").dictionary_encode()
            runs = np.flatnonzero(np.diff(code.indices.to_numpy(), prepend=-1)).tolist() + [b.num_rows]
            kept, by = [], []
            for lo, hi in zip(runs[:-1], runs[1:], strict=True):
                medium_ = b.column("m")[lo].as_py()
                if medium_ != now:
                    now, last = medium_, None
                i = lo
                while i < hi:
                    if last is None:
                        d = None
                    else:
                        stop = min(i + 256, hi)  # looked at together; the first that is due becomes the one to compare with
                        diff = np.full(stop - i, 255.0)
                        same = np.flatnonzero((size[i:stop] == len(last)) & (len(last) > 0))
                        if len(same):
                            rows = data[bounds[i:stop][same][:, None] + np.arange(len(last))].astype(np.int16)
                            diff[same] = np.abs(rows - last).sum(1) / len(last)
                        due = diff >= threshold
                        if max_gap is not None:
                            due |= times[i:stop] - since >= max_gap
                        if not due.any():
                            i = stop
                            continue
                        first = int(np.argmax(due))
                        i, d = i + first, float(diff[first])
                    last, since = data[bounds[i] : bounds[i + 1]].astype(np.int16), int(times[i])
                    kept.append(i)
                    by.append(d)
                    i += 1
            if kept:
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([b.column("m").take(at), b.column("s").take(at), pa.array(by, pa.float64())], [medium, second, "difference"])

    kind = read.schema["m"].dataType.simpleString()
    return read.repartition("m").sortWithinPartitions("m", "s", "g").mapInArrow(fold, f"`{medium}` {kind}, `{second}` bigint, difference double")


def prints(pictures: DataFrame, key: str, grey: str) -> DataFrame:
    """key, print: 64 bits of each picture of 32 x 32 grey values: whether each of its 8 x 8 lowest frequencies is above the median
    (the 32nd of 63 in order; the mean brightness is left out of these). The first frequency is the highest bit, rows of
    frequencies follow one another. Null for grey values of another size."""
    read = pictures.select(F.col(key).alias(key), F.col(grey).cast("binary").alias("_g"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                grey_ = part.column("_g").fill_null(b"")
                data, bounds = _bytes(grey_)
                fits = np.flatnonzero(np.diff(bounds) == SIZE * SIZE)
                x = data[bounds[:-1][fits][:, None] + np.arange(SIZE * SIZE)].reshape(-1, SIZE, SIZE).astype(float) if len(fits) else np.zeros((0, SIZE, SIZE))
                f = (_COSINES @ (x @ _COSINES.T)).reshape(-1, LOW * LOW)  # along the rows, then down the columns
                bits = f > np.sort(f[:, 1:], 1)[:, (LOW * LOW - 1) // 2, None]
                out = np.zeros(part.num_rows, np.int64)
                out[fits] = np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
                missing = np.ones(part.num_rows, bool)
                missing[fits] = False
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, mask=missing)], [key, "print"])

    kind = read.schema[key].dataType.simpleString()
    return read.mapInArrow(transform, f"`{key}` {kind}, print bigint")


def apart(a: Column, b: Column) -> Column:
    """How many of the 64 bits of two prints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def blocks(bits: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """(kind, part, other part, bits to flip in that) of the blocks that a print lies in, and of those that it asks."""
    n = len(WIDTHS)
    equal = [(i * n + j, i, j, 0) for i in range(n) for j in range(i + 1, n)]
    near = [(n * n + i, i, (i + 1) % n) for i in range(n)] if bits == n - 1 else []
    return equal + [(*x, 0) for x in near], equal + [(*x, 1 << f) for x in near for f in range(WIDTHS[x[2]])]


def close_ties(rows: DataFrame, key: str, prints_: str, bits: int = 4) -> DataFrame:
    """a, b: pairs of different prints no more than `bits` (4 at most) apart, each by its smallest key; equal ones are a tie of
    another kind (groups.exact_ties). Null prints tie nothing.

    Of two such prints two parts are equal, or one is and each of the four others differs in one bit. So a block holds two parts'
    bits (25 or more): those of any two parts, or those of a part and the next one, of which one side tries out each bit. Prints
    that agree in one part alone never meet by it. Only prints and a block's number are shuffled."""
    n = len(WIDTHS)
    if bits > n - 1:
        raise ValueError(f"prints are blocked for up to {n - 1} bits")
    starts = [sum(WIDTHS[:i]) for i in range(n)]
    one = rows.where(F.col(prints_).isNotNull()).groupBy(F.col(prints_).alias("p")).agg(F.min(key).alias("k"))
    held_in, asked_in = blocks(bits)

    def keyed(flips: list[tuple[int, int, int, int]], p: str) -> DataFrame:
        """Each print with the number of each of its blocks, made of (kind, part, other part, bits to flip in that)."""
        part = lambda i: F.shiftright("p", starts[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))
        wide = max(WIDTHS)
        number = lambda at, i, j, flip: F.lit(at << 2 * wide).cast("long") + F.shiftleft(part(i), wide) + part(j).bitwiseXOR(F.lit(flip).cast("long"))
        return one.select(F.col("p").alias(p), F.explode(F.array(*(number(*f) for f in flips))).alias("block"))

    met = keyed(asked_in, "p").join(keyed(held_in, "q"), "block").where((F.col("p") != F.col("q")) & (apart(F.col("p"), F.col("q")) <= bits))
    met = met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    near = met.join(one.select("p", F.col("k").alias("_k")), "p").join(one.select(F.col("p").alias("q"), F.col("k").alias("_l")), "q")
    return near.select(F.least("_k", "_l").alias("a"), F.greatest("_k", "_l").alias("b"))
