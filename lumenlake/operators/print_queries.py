"""Registered queries over grey values, which are made of the embeddings by a fixed rule, each beside its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenlake.operators import prints
from lumenlake.operators.prints import SIZE
from lumenlake.operators.registry import _query, _t

_GREY = "CAST(greatest(0, least(255, floor(128 + 900 * {x} * {y}))) AS INT)"
_PX = f"list_transform(range(1024), lambda i: {_GREY.format(x='e[1 + i // 32]', y='e[33 + i % 32]')})"
_COS = "c AS (SELECT u, x, cos((2 * x + 1) * u * pi() / 64) AS w FROM range(8) a(u), range(32) b(x))"


def _greyed(rows):
    """rows with grey in place of e, a list of 64 numbers: a picture of 32 x 32, the first half down, the second half across. Where a
    number is null the picture is white."""
    names = [*(c for c in rows.columns if c != "e"), "grey"]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                flat = b.column("e").flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 64)
                none = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, 64)
                with np.errstate(all="ignore"):
                    value = np.nan_to_num(np.clip(np.floor(128 + 900 * x[:, :32, None] * x[:, None, 32:]), 0, 255))
                value[none[:, :32, None] | none[:, None, 32:]] = 255
                greys = value.astype(np.uint8).reshape(-1, SIZE * SIZE)
                ends = pa.py_buffer(np.arange(len(greys) + 1, dtype=np.int32) * (SIZE * SIZE))
                grey = pa.Array.from_buffers(pa.binary(), len(greys), [None, ends, pa.py_buffer(np.ascontiguousarray(greys))])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), grey], names)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names[:-1])
    return rows.mapInArrow(drawn, f"{kinds}, grey binary")


def _numbers(spark, sf, key):
    """The embeddings' key, label and 64 numbers; what a list lacks is null."""
    e = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", i).cast("double"))
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias(key), "label", e.alias("e"))


def _grey(spark, sf):
    """Pictures of 32 x 32: an embedding's first half down, its second half across."""
    return _greyed(_numbers(spark, sf, "vec_id"))


def _frames(spark, sf):
    """Videos of 40 frames each; some frames repeat the one before them."""
    number = (F.col("vec_id") - F.when(F.col("vec_id") % 40 % 3 == 2, 1).otherwise(0)).alias("shown")
    shows = _t(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("medium"), (F.col("vec_id") % 40).alias("second"), number)
    return _greyed(shows.join(_numbers(spark, sf, "shown"), "shown").select("medium", "second", "e"))


@_query(f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), g AS (SELECT vec_id, {_PX} AS px FROM e),
f AS (SELECT n.vec_id // 40 AS medium, n.vec_id % 40 AS second, px FROM embeddings n JOIN g ON g.vec_id = n.vec_id - CASE WHEN n.vec_id % 40 % 3 = 2 THEN 1 ELSE 0 END),
d AS (SELECT a.medium, a.second AS last, b.second, list_sum(list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2]))) / 1024 AS diff FROM f a JOIN f b ON a.medium = b.medium AND a.second < b.second),
k AS (SELECT medium, min(second) AS second, NULL::DOUBLE AS difference FROM f GROUP BY medium
UNION ALL SELECT k.medium, min(d.second), arg_min(diff, d.second) FROM k JOIN d ON d.medium = k.medium AND d.last = k.second AND (diff >= 18 OR d.second - d.last >= 7) GROUP BY k.medium)
SELECT medium, second, round(coalesce(difference, -1), 6) AS difference FROM k""")
def frames_changed(spark, sf):
    return prints.changed(_frames(spark, sf), "medium", "second", "grey", 18.0, 7).withColumn("difference", F.round(F.coalesce("difference", F.lit(-1.0)), 6))


@_query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT vec_id, i // 32 AS y, i % 32 AS x, px[i + 1] AS g FROM (SELECT vec_id, {_PX} AS px FROM e), range(1024) r(i)), {_COS},
r AS (SELECT vec_id, y, u, sum(g * w) AS s FROM p JOIN c USING (x) GROUP BY ALL), f AS (SELECT vec_id, c.u AS v, r.u, sum(s * w) AS f FROM r JOIN c ON c.x = r.y GROUP BY ALL),
m AS (SELECT vec_id, list_sort(list(f))[32] AS median FROM f WHERE u + v > 0 GROUP BY 1)
SELECT vec_id, CAST(sum(CASE WHEN f > median THEN CASE WHEN u + v = 0 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << CAST(63 - 8 * v - u AS INT)) END ELSE 0 END) AS BIGINT) AS print FROM f JOIN m USING (vec_id) GROUP BY 1""")
def picture_prints(spark, sf):
    return prints.prints(_grey(spark, sf), "vec_id", "grey")


_SHIFTED = "p AS (SELECT doc_id AS k, CAST(list_reduce(list_transform(range(1, 16), lambda i: CAST(strpos('0123456789abcdef', md5(CAST(doc_id // 8 AS VARCHAR))[i:i]) - 1 AS BIGINT)), lambda a, b: (a << 4) | b) AS BIGINT) AS base, doc_id % 8 AS n FROM documents), q AS (SELECT k, xor(base, (1::BIGINT << CAST(k * 7 % 59 AS INT)) * (n % 2) + (1::BIGINT << CAST(k * 13 % 59 AS INT)) * (n // 2 % 2)) AS p FROM p)"


@_query(f"WITH {_SHIFTED}, one AS (SELECT p, min(k) AS k FROM q GROUP BY 1) SELECT x.k AS a, y.k AS b FROM one x JOIN one y ON x.k < y.k AND bit_count(xor(x.p, y.p)) <= 4")
def close_prints(spark, sf):
    k = F.col("doc_id")
    base = F.conv(F.substring(F.md5(F.floor(k / 8).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    flip = lambda by, on: F.when(on % 2 == 1, F.expr(f"shiftleft(1L, CAST(doc_id * {by} % 59 AS INT))")).otherwise(F.lit(0).cast("long"))
    flips = flip(7, k % 8) + flip(13, F.floor(k % 8 / 2))
    return prints.close_ties(_t(spark, sf, "documents").select("doc_id", base.bitwiseXOR(flips).alias("p")), "doc_id", "p")
