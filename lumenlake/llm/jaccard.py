"""Exact Jaccard join of shingle sets in the metric space of the Jaccard distance d(x, y) = 1 - |x & y| / |x | y|.

In this space unrelated texts all lie at distance 1 of any pivot, so a few pivots for the whole corpus would put every text on
every region's boundary. Pivots are therefore elected among the texts that share a rare shingle, and there are as many as it
takes:

1. Texts with equal sets are one node (a fingerprint of the set). Shingles have one order for all texts: by the number of
   texts that hold them, counted over all; those that a bounded sample shows to be very common come last and are not counted.
   Two linked nodes share one of the first n - ceil(t n) + 1 shingles of each (n: the set's size, t: the threshold), its
   signatures. One that no other text holds signs nothing, so most texts have no signature at all.
2. Pivots. Each signature elects a pivot: the smallest node that has it or, for a common shingle, the sample's node with most
   common shingles. A region holds the nodes that elected one pivot, so any linked pair meets in a region.
3. A parity sketch of SKETCH bits (a bit for the parity of the shingles that fall on it) gives h(x, y), a Hamming distance that
   is a metric and never above the symmetric difference. Nodes whose h and size allow a link to their pivot are verified by
   exact intersection; those that link are its Voronoi cell and need no comparison with each other.
4. The nodes left open (in another component than their pivot) are joined with their region: it is cut by distance to the
   pivot into pieces, a piece is replicated to those windows only that the triangle inequality |h(x,p) - h(y,p)| <= h(x,y)
   leaves, and pairs that size and h allow are verified. This recurs: the nearest few of each open node first, and as found
   links unite components there is less left open for the next, wider round, until no pair between components is left.

No cap is involved: a pair is either verified by exact intersection, excluded by a bound, or of one component already.

Defined cases: null, empty and wordless texts have no shingles, link with nothing and are components of their own; texts
shorter than k words are one shingle; rows that repeat are linked as equal sets; rows without a doc_id get a null
component; extra columns are ignored; an empty table gives no rows. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenlake.llm import common as C
from lumenlake.llm.graph import components

SKETCH = 1024
#: Members of a piece of a region; pairs of one task with a pivot or with a verified node.
PIECE, PAIRS = 4096, 256
#: Each open node is compared with so many of its nearest first, then with the next ones.
NEAREST = (4, 64, 1024, 1 << 62)
#: Shingles are counted in so many ranges of hashes for each shuffle partition.
RANGES = 4
#: Rows of a block: their places in it are written in two bytes.
BLOCK_ROWS = 60_000
#: Shingles found in at least COMMON of COMMON_SAMPLE texts are called common.
COMMON, COMMON_SAMPLE = 4, 2048


def sets_of(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct shingles of the texts of a block, their bounds, and each set's fingerprint (0 for none)."""
    h, r = C.shingles(C.split(data, bounds), k)
    h, at = C.distinct(h, r, len(bounds) - 1)
    n = np.diff(at)
    f = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        f[full] = C.mix(np.add.reduceat(C.mix(h ^ np.uint64(0xA5A5A5A5)), at[full]) + n[full].astype(np.uint64)) | np.uint64(1)
    return h, at, f


def set_hashes(docs: DataFrame, k: int, name: str) -> DataFrame:
    """docs with the fingerprint of each text's shingle set under a name that no column of docs has."""
    from pyspark.sql import types as T

    def rows(batches):
        for b in batches:
            found = [sets_of(data, bounds, k)[2].view(np.int64) for _, _, data, bounds in C.blocks(b.columns[-1])]
            yield pa.record_batch([*b.columns[:-1], pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names)

    names = [*docs.columns, name]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.select("*", docs["text"].cast("binary").alias(name)).mapInArrow(rows, schema)


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, SKETCH / 64) words: the parity of the shingles that fall on each bit."""
    n = len(at) - 1
    out = np.zeros((n, SKETCH // 8), np.uint8)
    spot = (C.mix(h + np.uint64(0x51)) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))
    for lo in range(0, n, 1000):
        a, b = at[lo], at[min(n, lo + 1000)]
        rows = min(n, lo + 1000) - lo
        odd = np.bincount((owner[a:b] - lo) * SKETCH + spot[a:b], minlength=rows * SKETCH) & 1
        out[lo : lo + rows] = np.packbits(odd.astype(np.uint8).reshape(rows, SKETCH), axis=1)
    return out.view(np.uint64)


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of each size sign."""
    return n - (percent * n + 99) // 100 + 1


def _long(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64)


#: Rows of step 1. kind 0: the texts of a block (ids, whether null, fingerprints, sizes, sketches, shingles not common, and pairs
#: of nodes with pivots); kind 1: the shingles of a block in a range of hashes (six bytes each, place of the text in the block),
#: then those of them that are in several texts (shingle, place, number of texts).
PACKED = "part int, block long, kind int, a binary, b binary, c binary, d binary, e binary, g binary, x binary, y binary"


def _row(part: int, block: int, kind: int, *fields: np.ndarray) -> tuple:
    return part, block, kind, *(x.tobytes() for x in fields), *[None] * (8 - len(fields))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 8]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["part", "block", "kind", *"abcdegxy"])


def _packed(k: int, percent: int, ranges: int, shared):
    """mapInArrow over texts to rows of step 1, before counting."""
    from pyspark import TaskContext

    def rows(batches):
        common, pivot = shared.value
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(start, BLOCK_ROWS)
                for lo, hi, data, bounds in C.blocks(b.column("text")):
                    h, at, f = sets_of(data, bounds, k)
                    n, ids = np.diff(at), b.column("_id").slice(lo, hi - lo)
                    null = ids.is_null().to_numpy(zero_copy_only=False)
                    owner = np.repeat(np.arange(hi - lo), n)
                    spot = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
                    late = common[spot] == h if len(common) else np.zeros(len(h), bool)
                    some = n - np.bincount(owner[late], minlength=hi - lo)
                    # Common shingles sign last, in order of their hashes; each names its pivot.
                    rank = np.cumsum(late) - np.concatenate([[0], np.cumsum(late)])[at[:-1]][owner]
                    sign = late & (rank <= (prefix(n, percent) - some)[owner]) & ~null[owner]
                    pairs = np.unique(np.stack([f[owner[sign]].view(np.int64), pivot[spot[sign]]]), axis=1) if sign.any() else np.zeros((2, 0), np.int64)
                    out = [_row(block % ranges, block, 0, ids.fill_null(0).to_numpy(), null, f, n, sketches(h, at), some, pairs[0], pairs[1])]
                    rest = ~late & ~null[owner]
                    hh, oo = h[rest], owner[rest]
                    part = ((hh >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                    order = np.argsort(part, kind="stable")
                    hh, oo, part = hh[order].view(np.uint8).reshape(-1, 8)[:, :6], oo[order].astype(np.uint16), part[order]
                    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0]
                    out += [_row(int(part[i]), block, 1, hh[i:j], oo[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                    block += 1
                    yield _batch(out)

    return rows


def _counted(batches):
    """mapInArrow over rows of step 1 sorted by part: leaves of the shingles those that are in several texts, with the number."""

    def solve(part: int, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        size = [len(x) // 6 for _, x, _ in held]
        h = np.zeros((sum(size), 8), np.uint8)
        h[:, :6] = np.frombuffer(b"".join(x for _, x, _ in held), np.uint8).reshape(-1, 6)
        h = h.view(np.uint64).ravel()
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        count = np.empty(len(h), np.int64)
        count[order] = np.repeat(np.diff(np.append(first, len(h))), np.diff(np.append(first, len(h))))
        h = C.mix(h | np.uint64(part % 65536 << 48))
        out, lo = [], 0
        for (block, _, place), m in zip(held, size, strict=True):
            many = count[lo : lo + m] > 1
            if many.any():
                out.append(_row(part, block, 1, h[lo : lo + m][many], np.frombuffer(place, np.uint16)[many], count[lo : lo + m][many]))
            lo += m
        return _batch(out)

    part, held = None, []
    for b in batches:
        kind = b.column("kind").to_numpy()
        yield b.filter(pa.array(kind == 0))
        for i in np.flatnonzero(kind == 1):
            if (p := b.column("part")[i].as_py()) != part and held:
                yield solve(part, held)
                held = []
            part = p
            held.append((b.column("block")[i].as_py(), b.column("a")[i].as_py(), b.column("b")[i].as_py()))
    if held:
        yield solve(part, held)


def _measured(batches):
    """_id, f, n, sketch of each text, from the rows of kind 0."""
    for b in batches:
        for r in b.to_pylist():
            n = len(r["b"])
            size = len(r["e"]) // max(n, 1)
            yield pa.record_batch([pa.array(_long(r["a"]), mask=np.frombuffer(r["b"], bool)), pa.array(_long(r["c"])), pa.array(_long(r["d"])), pa.array([r["e"][i * size : (i + 1) * size] for i in range(n)], pa.binary())], ["_id", "f", "n", "sketch"])


def _signed(percent: int):
    """mapInArrow over counted rows sorted by block and kind: sig, f, p. p: the pivot that a common shingle names; such a row
    has a sig of its own and meets no other."""

    def solve(head: dict, held: list[dict]) -> pa.RecordBatch:
        f, n, some = _long(head["c"]), _long(head["d"]), _long(head["g"])
        own, named = _long(head["x"]), _long(head["y"])
        h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["a"], np.uint64) for r in held)])
        place = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r["b"], np.uint16) for r in held)])
        count = np.concatenate([np.zeros(0, np.int64), *(_long(r["c"]) for r in held)])
        order = np.lexsort((h, count, place))
        h, place = h[order], place[order]
        many = np.bincount(place, minlength=len(f))
        rank = np.arange(len(h)) - np.concatenate([[0], np.cumsum(many)])[place]
        sign = rank < (np.minimum(prefix(n, percent), some) - (some - many))[place]  # the unshared ones come first
        pairs = np.unique(np.stack([h[sign].view(np.int64), f[place[sign]]]), axis=1)
        return pa.record_batch([pa.array(np.concatenate([pairs[0], own ^ named])), pa.array(np.concatenate([pairs[1], own])), pa.array(np.concatenate([pairs[1], named]), mask=np.concatenate([np.ones(pairs.shape[1], bool), np.zeros(len(own), bool)]))], ["sig", "f", "p"])

    def rows(batches):
        head, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    if head:
                        yield solve(head, held)
                    head, held = r, []
                else:
                    held.append(r)
        if head:
            yield solve(head, held)

    return rows


def _common(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles that are frequent in a bounded sample, the pivot of each); it steers the work, not the result."""
    ids = docs.select("_id").where("_id is not null").orderBy(F.xxhash64("_id")).limit(COMMON_SAMPLE).select(F.col("_id").alias("_chosen"))

    def rows(batches):
        for b in batches:
            for _, _, data, bounds in C.blocks(b.column("text")):
                h, at, f = sets_of(data, bounds, k)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.repeat(f.view(np.int64), np.diff(at)))], ["h", "f"])

    sample = docs.join(F.broadcast(ids), F.col("_id") == F.col("_chosen"), "left_semi").select("text")
    each = sample.mapInArrow(rows, "h long, f long")
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).select("h")
    score = C.stored(each.distinct().join(often, "h"), "common")
    best = score.groupBy("f").count()
    top = score.join(best, "f").groupBy("h").agg(F.max(F.struct("count", "f")).alias("p")).select("h", "p.f").toArrow()
    h, f = top.column("h").to_numpy().view(np.uint64), top.column("f").to_numpy()
    order = np.argsort(h)
    return h[order], f[order]


def bound(percent: int, a, b):
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (100 - percent) * (a + b) / (100 + percent)


def _may(percent: int, h: Column, a: Column, b: Column) -> Column:
    return (h * (100 + percent) <= (100 - percent) * (a + b)) & (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _distances(batches):
    """h: the Hamming distance of each node's sketch to its pivot's."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for c in ("sketch", "p_sketch"))
        yield pa.record_batch([*(b.column(c) for c in ("p", "p_id", "p_n", "f", "id", "n", "sketch")), pa.array(np.bitwise_count(x ^ y).sum(1).astype(np.int64))], ["p", "p_id", "p_n", "f", "id", "n", "sketch", "h"])


def _near(percent: int, least: int, most: int):
    """mapInArrow over rows sorted by task: of each open node (side 0) and the others of its window (side 1), the pairs
    between components that size and sketch allow, from the least-nearest to the most-nearest of the open node; and one
    row without b where more are left."""

    def solve(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        side = rows["side"]
        y, x = ({c: v[side == s] for c, v in rows.items()} for s in (0, 1))
        order = np.argsort(x["h"], kind="stable")
        x = {c: v[order] for c, v in x.items()}
        out: list[tuple] = []
        widest = bound(percent, x["n"].max(initial=0), 0)
        step = 256
        order = np.argsort(y["h"], kind="stable")
        for lo in range(0, len(order), step):
            mine = order[lo : lo + step]
            reach = widest + bound(percent, y["n"][mine].max(), 0)
            a = np.searchsorted(x["h"], y["h"][mine].min() - reach, "left")
            z = np.searchsorted(x["h"], y["h"][mine].max() + reach, "right")
            for i in mine:  # one open node against its window
                h = np.bitwise_count(x["sketch"][a:z] ^ y["sketch"][i]).sum(1)
                nx, ny = x["n"][a:z], y["n"][i]
                ok = (h <= bound(percent, nx, ny)) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
                ok &= (x["open"][a:z] == 0) | (x["f"][a:z] > y["f"][i])
                ok &= x["f"][a:z] != y["f"][i]
                some = np.flatnonzero(ok)
                if not len(some):
                    continue
                some = some[np.lexsort((x["f"][a:z][some], h[some]))] + a
                other = x["c"][some] != y["c"][i]
                now = some[least:most][other[least:most]]
                out += [(y["f"][i], y["id"][i], x["f"][j], x["id"][j]) for j in now]
                if other[most:].any():
                    out.append((y["f"][i], y["id"][i], None, None))
        return pa.record_batch([pa.array([o[c] if o[c] is None else int(o[c]) for o in out], pa.int64()) for c in range(4)], ["a", "a_id", "b", "b_id"])

    names = ("side", "f", "id", "n", "h", "c", "open")

    def rows(batches):
        task, held = None, []

        def done():
            got = {c: np.concatenate([p[c] for p in held]) for c in (*names, "sketch")}
            return solve(got)

        for b in batches:
            t = b.column("task").to_numpy()
            cut = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi == lo:
                    continue
                if t[lo] != task and held:
                    yield done()
                    held = []
                task = t[lo]
                part = b.slice(lo, hi - lo)
                held.append({c: part.column(c).to_numpy() for c in names} | {"sketch": np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)})
        if held:
            yield done()

    return rows


def _verified(slim: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b of the pairs (a, a_id, b, b_id) that link. All nodes paired with one b are dealt over tasks of PAIRS, each with b's
    text; texts are shuffled, being smaller than their sets, and b's set is all that a task holds."""
    pairs = C.stored(pairs.distinct(), "pairs")
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    left = dealt.select("b", "part", F.lit(1).alias("side"), F.col("a").alias("f"), F.col("a_id").alias("_of"))
    right = dealt.groupBy("b", "part").agg(F.first("b_id").alias("_of")).select("b", "part", F.lit(0).alias("side"), F.col("b").alias("f"), "_of")
    want = left.union(right)
    rows = C.semi(slim, "_id", want, "_of").join(want, F.col("_id") == F.col("_of")).select("b", "part", "side", "f", "text")

    def check(batches):
        key, one = None, None
        for b in batches:
            want, side, task, part = (b.column(c).to_numpy() for c in ("f", "side", "b", "part"))
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                h, at, f = sets_of(data, bounds, k)
                x, y = [], []
                for i in range(hi - lo):
                    r = lo + i
                    if f[i].view(np.int64) != want[r]:  # another text under the same doc_id
                        continue
                    s = h[at[i] : at[i + 1]]
                    if side[r] == 0:
                        key, one = (task[r], part[r]), s
                    elif key == (task[r], part[r]):
                        both = int((one[np.minimum(np.searchsorted(one, s), len(one) - 1)] == s).sum())
                        if 100 * both >= percent * (len(one) + len(s) - both):
                            x.append(want[r])
                            y.append(task[r])
                yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return C.stored(rows.repartition("b", "part").sortWithinPartitions("b", "part", "side").mapInArrow(check, "a long, b long"), "links")


def _windows(regions: DataFrame, percent: int) -> DataFrame:
    """task and side of each row of regions (p, f, n, h, c, open): pieces by distance to the pivot, paired by the triangle
    inequality where one has an open node."""
    count = regions.groupBy("p", "h").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("p").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = count.select("p", "h", F.floor(before / PIECE).alias("g"), F.ceil(F.col("m") / PIECE).alias("salts"))
    cut = C.stored(regions.join(cells, ["p", "h"]).withColumn("g", F.struct("g", F.pmod(F.xxhash64("f"), "salts").alias("s"))).drop("salts"), "cut")
    piece = cut.groupBy("p", "g").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("n").alias("n"), F.max("open").alias("open"))
    one = piece.where("open = 1").select("p", *(F.col(c).alias(f"y_{c}") for c in ("g", "lo", "hi", "n")))
    reach = bound(percent, F.col("n"), F.col("y_n"))
    pairs = piece.join(one, "p").where((F.col("lo") - F.col("y_hi") <= reach) & (F.col("y_lo") - F.col("hi") <= reach)).select("p", "g", "y_g", F.xxhash64("p", "g", "y_g").alias("task"))
    sides = pairs.select("p", "g", "task", F.lit(1).alias("side")).union(pairs.select("p", F.col("y_g").alias("g"), "task", F.lit(0).alias("side")))
    return cut.join(sides, ["p", "g"]).where("side = 1 or open = 1")


def near_components(docs: DataFrame, k: int = 4, percent: int = 85, by_set: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); with by_set also set_hash, as set_hashes tells it."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("_id"), C.byte_texts(docs))
    shared = spark.sparkContext.broadcast(_common(slim, k))  # of a bounded sample

    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = slim.mapInArrow(_packed(k, percent, ranges, shared), PACKED)
    counted = C.stored(packed.repartition("part").sortWithinPartitions("part").mapInArrow(_counted, PACKED), "counted")
    rows = C.stored(counted.where("kind = 0").mapInArrow(_measured, "_id long, f long, n long, sketch binary"), "measured")
    sig = counted.drop("e").repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_signed(percent), "sig long, f long, p long")
    # A common signature never meets in a task, for its nodes name its pivot themselves.
    elected = sig.select("f", F.coalesce("p", F.first("f").over(W.partitionBy("sig").orderBy("f"))).alias("p")).where("f <> p").distinct()
    elected = C.stored(elected, "elected")
    members = elected.union(elected.select("p", "p").distinct())
    node = rows.where("n > 0 and _id is not null").groupBy("f").agg(F.min("_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    used = C.stored(node.join(members.select("f").distinct(), "f", "left_semi"), "nodes")
    heads = used.select(F.col("f").alias("p"), F.col("id").alias("p_id"), F.col("n").alias("p_n"), F.col("sketch").alias("p_sketch"))
    regions = members.join(used, "f").join(heads, "p").select("p", "p_id", "p_n", "p_sketch", "f", "id", "n", "sketch")
    regions = C.stored(regions.mapInArrow(_distances, "p long, p_id long, p_n long, f long, id long, n long, sketch binary, h long"), "regions")
    close = regions.where((F.col("f") != F.col("p")) & _may(percent, F.col("h"), F.col("n"), F.col("p_n")))
    links = _verified(slim, close.select(F.col("f").alias("a"), F.col("id").alias("a_id"), F.col("p").alias("b"), F.col("p_id").alias("b_id")), k, percent)
    final, least = C.stored(components(links), "classes"), 0
    for most in NEAREST:
        at = regions.join(final.select(F.col("node").alias("f"), "component"), "f", "left").withColumn("c", F.coalesce("component", "f")).drop("component")
        at = at.join(final.select(F.col("node").alias("p"), "component"), "p", "left").withColumn("open", (F.col("c") != F.coalesce("component", "p")).cast("int"))
        at = at.select("p", "f", "id", "n", "sketch", "h", "c", "open")
        left = at.where("open = 1").select("p").distinct()
        tasks = _windows(at.join(left, "p", "left_semi"), percent).select("task", "side", "f", "id", "n", "h", "c", "open", "sketch")
        found = C.stored(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_near(percent, least, most), "a long, a_id long, b long, b_id long"), "near")
        pairs = found.where("b is not null")
        if not pairs.isEmpty():
            links = links.union(_verified(slim, pairs, k, percent))
            final = C.stored(components(links), "classes")
        if found.where("b is null").isEmpty():
            break
        least = most
    # Each node's component, then the smallest doc_id in it.
    named = rows.select("_id", "f", "n").join(final.select(F.col("node").alias("f"), "component"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    lowest = C.stored(named.where("n > 0 and _id is not null").groupBy("component").agg(F.min("_id").alias("component_id")), "lowest")
    out = named.join(lowest, "component", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("_id").isNotNull(), F.col("component_id"))).otherwise(F.col("_id")).alias("component_id"), *([F.col("f").alias("set_hash")] if by_set else []))
