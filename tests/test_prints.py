"""Frames that change and prints of pictures against plain Python."""

import math
import random

import pytest

from lumenlake.operators import prints


def kept(frames, threshold, gap):
    out, last, since = [], None, 0
    for second, grey in sorted(frames):
        d = None if last is None else 255.0 if len(last) != len(grey) or not grey else sum(abs(a - b) for a, b in zip(last, grey, strict=True)) / len(grey)
        if last is None or d >= threshold or (gap is not None and second - since >= gap):
            last, since = grey, second
            out.append((second, d))
    return out


@pytest.mark.parametrize("gap", [None, 9])
def test_frames_are_compared_with_the_last_one_kept(spark, gap):
    rng = random.Random(3)
    videos = {}
    for medium in range(6):
        grey, frames = [rng.randrange(256) for _ in range(16)], []
        for second in range(3000 if medium == 0 else 40):  # the long one crosses batches
            grey = [min(255, max(0, g + rng.choice([-2, 0, 1, 3]))) for g in grey] if rng.random() < 0.8 else grey  # slow drift adds up
            frames.append((second, bytes(grey)))
        videos[medium] = frames
    videos[6] = [(0, b""), (1, b""), (2, b"ab"), (3, b"abc"), (3, b"abc"), (3, b"abz"), (4, b"abz")]
    rows = [(m, s, g, "x") for m, f in videos.items() for s, g in f] + [(None, 1, b"a", "x"), (1, None, b"a", "x"), (9, 1, None, "x")]
    df = spark.createDataFrame(rows, "medium long, second long, grey binary, difference string").repartition(4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        got = sorted((tuple(r) for r in prints.changed(df, "medium", "second", "grey", 6.0, gap).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == sorted(((m, *k) for m, f in videos.items() for k in kept(f, 6.0, gap)), key=repr)
    assert prints.changed(df.limit(0), "medium", "second", "grey").count() == 0


def printed(grey):
    cos = lambda u, x: math.cos((2 * x + 1) * u * math.pi / 64)
    f = [sum(grey[32 * y + x] * cos(u, x) * cos(v, y) for y in range(32) for x in range(32)) for v in range(8) for u in range(8)]
    median = sorted(f[1:])[31]
    bits = sum(1 << (63 - i) for i, value in enumerate(f) if value > median)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def test_prints(spark):
    rng = random.Random(8)
    some = {i: bytes(rng.randrange(256) for _ in range(1024)) for i in range(5)}
    df = spark.createDataFrame([*some.items(), (7, None), (8, b"short"), (None, some[0])], "k long, grey binary")
    want = {(k, printed(g)) for k, g in some.items()} | {(7, None), (8, None), (None, printed(some[0]))}
    assert {tuple(r) for r in prints.prints(df, "k", "grey").collect()} == want and len({p for _, p in want}) == 6
    assert prints.prints(df.limit(0), "k", "grey").count() == 0


def test_close_ties_find_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for base in (rng.getrandbits(64) for _ in range(40)):
        for _ in range(6):
            p = base
            for bit in rng.sample(range(64), rng.randrange(6)):
                p ^= 1 << bit
            rows.append((len(rows), p - (1 << 64) if p >= 1 << 63 else p))
    rows += [(1000, rows[0][1]), (1001, None)]
    least = {}
    for k, p in rows:
        if p is not None:
            least[p] = min(k, least.get(p, k))
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    one = sorted((k, p) for p, k in least.items())
    for bits in (4, 2):
        want = {(a, b) for a, p in one for b, q in one if a < b and apart(p, q) <= bits}
        assert {tuple(r) for r in prints.close_ties(spark.createDataFrame(rows, "k long, p long"), "k", "p", bits).collect()} == want and want
    with pytest.raises(ValueError):
        prints.close_ties(spark.createDataFrame(rows, "k long, p long"), "k", "p", 5)


def test_few_blocks_find_prints_that_differ_in_each_part_but_one(spark):
    rng, rows, want = random.Random(9), [], set()
    at = [sum(prints.WIDTHS[:i]) for i in range(len(prints.WIDTHS))]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    for same in range(len(prints.WIDTHS)):
        for n in range(20):
            p, flips = rng.getrandbits(64), sum(1 << (at[i] + rng.randrange(w)) for i, w in enumerate(prints.WIDTHS) if i != same)
            k = same * 100 + n * 2
            rows += [(k, signed(p)), (k + 1, signed(p ^ flips))]
            want.add((k, k + 1))
    got = prints.close_ties(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want)
    assert sum(map(len, prints.blocks(4))) < 100  # were 276 and 20


def test_pictures_of_lists_as_their_sql_draws_them(spark, tmp_path):
    import numpy as np

    from lumenlake.operators import print_queries as Q

    lists = [[(-1) ** i * i / 64 for i in range(64)], [0.5] * 63 + [None], [0.5] * 40, None, [float("nan")] + [0.2] * 63, [float("inf")] * 64, [0.0] + [float("-inf")] * 63]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(lists)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    frame = Q._grey(spark, str(tmp_path))
    assert "hex" not in frame._jdf.queryExecution().optimizedPlan().toString()  # no list of 1,024 texts for each picture
    got = {r["vec_id"]: bytes(r["grey"]) for r in frame.collect()}
    for k, v in enumerate(lists):
        e = [None if x is None else float(np.float32(x)) for x in [*(v or []), *[None] * 64][:64]]
        for i in range(1024):
            a, b = e[i // 32], e[32 + i % 32]
            x = 255.0 if a is None or b is None else 128 + 900 * a * b
            assert got[k][i] == (0 if math.isnan(x) else int(max(0, min(255, math.floor(x) if math.isfinite(x) else x)))), (k, i)
