"""Source divergence audit: how the word shares of each (lang, source) group differ from its peers' and from its language's.

Terms are runs of letters of ASCII and of anything beyond it, A-Z in small letters. A language keeps the terms that at least
min_docs of its documents hold. Groups are dealt to blocks of a few, their counts to shards of terms, and each (language, shard,
block) stays in one task while the packed counts of its peers come by in the rounds of a tournament: every two blocks meet
once, and the meeting gives both directions. A task holds its own block and one visitor. Sums over shards are exact whole
numbers, so they do not depend on the order of the rounds.

Null text, lang and source count as empty ones; a group without terms takes part with all counts zero; a language without
kept terms has pairs of value 0 and no terms. Rows that repeat count each time; equal values are ranked by the bytes of the
item; an empty table gives no rows. Only the three columns are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.llm import common as C

#: Bytes that belong to no term.
GAPS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SCALE = 1_000_000_000
#: Parts of each language's terms, and groups of a block, whatever the size of the input.
SHARDS, BLOCK = 32, 4
_GAP = C._table(GAPS)
_TERM = "lang string, source string, term string, n bigint, docs bigint"


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)) by long division in three digits to the base 1,000, exact up to a
    divisor of 9 * 10^15."""
    of = total + 2 * terms
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, of)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digit
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of shares, which are at most 2 * 10^9."""
    return (p - q) * (p - q) // (p + q)


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group of columns lang, source, text.

    A block of texts is counted in its task first; the groups' sums follow from these."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                data = C._LOWER[data]
                solid = ~_GAP[data]
                if not solid.any():
                    continue
                first = solid.copy()
                first[1:] &= ~solid[:-1]
                heads = bounds[:-1][np.diff(bounds) > 0]
                first[heads] = solid[heads]
                start = np.flatnonzero(first)
                row = np.searchsorted(bounds, start, "right") - 1
                at = np.cumsum(solid) - 1  # where a byte lands once the gaps are gone
                letters = data[solid]
                offsets = np.append(at[start], len(letters)).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
                code, size = words.indices.to_numpy(), len(words.dictionary)
                pair = [b.column(c).slice(lo, hi - lo).dictionary_encode() for c in ("lang", "source")]
                group = pair[0].indices.to_numpy().astype(np.int64) * len(pair[1].dictionary) + pair[1].indices.to_numpy()
                held, times = np.unique(row * size + code, return_counts=True)  # once for each text
                keys, back = np.unique(group[held // size] * size + held % size, return_inverse=True)
                n = np.bincount(back, times, len(keys)).astype(np.int64)
                lang, source = np.divmod(keys // size, len(pair[1].dictionary))
                cols = [pair[0].dictionary.take(pa.array(lang)), pair[1].dictionary.take(pa.array(source)), words.dictionary.take(pa.array(keys % size)), pa.array(n), pa.array(np.bincount(back, minlength=len(keys)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])

    # Spark sums counts of words as bytes and reads them as text at the end: no byte of a term is lost on the way.
    parts = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(rows, _TERM.replace("term string", "term binary"))
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def opponent(block: Column, turn: Column, blocks: Column) -> Column:
    """The block that meets `block` in a round of the circle method: with an even number m of places, places a and b below the
    last meet in round (a + b) mod (m - 1), and the last meets the place that would meet itself. A place without a block is a
    rest."""
    m = blocks + blocks % 2
    other = F.pmod(turn - block, m - 1)
    return F.when(block == m - 1, F.pmod(turn * F.floor(m / 2), m - 1)).when(other == block, m - 1).otherwise(other).cast("int")


def _pack(*columns: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(c, np.int64).tobytes() for c in columns), 1)


def _unpack(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int64).reshape(width, -1)


_VECTOR = "lang string, shard int, block int, blocks int, terms bigint, total bigint, here bigint, sources array<string>, totals array<bigint>, counts binary, words array<string>, overall binary"


def _vectors(rows: DataFrame) -> DataFrame:
    """One row for each (lang, shard, block): its groups (source and sum of all counts), their counts in the shard as steps of
    (group, term) numbers, and for the block's own use the terms and the language's counts.

    rows hold lang, shard, block, blocks, terms, total, here, source, at (place in the block), id, n, overall, term; id is -1
    in the row that states a group and its sum n."""
    key = ["lang", "shard", "block"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            first = {c: t.column(c)[0] for c in (*key, "blocks", "terms", "total", "here")}
            at, ids, n = (t.column(c).to_numpy() for c in ("at", "id", "n"))
            head, body = np.flatnonzero(ids < 0), np.flatnonzero(ids >= 0)
            place = at[body].astype(np.int64) * first["here"].as_py() + ids[body]
            counts = _pack(np.diff(place, prepend=0), n[body])
            overall = _pack(t.column("overall").to_numpy()[body])
            cols = [pa.array([v.as_py()], v.type) for v in first.values()]
            cols += [pa.array([t.column("source").take(pa.array(head)).to_pylist()], pa.list_(pa.string())), pa.array([n[head].tolist()], pa.list_(pa.int64())), pa.array([counts], pa.binary())]
            cols += [pa.array([t.column("term").take(pa.array(body)).to_pylist()], pa.list_(pa.string())), pa.array([overall], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["lang", "shard", "block", "blocks", "terms", "total", "here", "sources", "totals", "counts", "words", "overall"])

        now: tuple | None = None
        for b in batches:
            lang = b.column("lang").dictionary_encode()
            code = np.stack([lang.indices.to_numpy(), b.column("shard").to_numpy(), b.column("block").to_numpy()])
            edges = np.concatenate([[0], np.flatnonzero((code[:, 1:] != code[:, :-1]).any(0)) + 1, [b.num_rows]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                this = (b.column("lang")[lo].as_py(), *code[1:, lo].tolist())
                if held and this != now:
                    yield made()
                    held.clear()
                held.append(b.slice(lo, hi - lo))
                now = this
        if held:
            yield made()

    return rows.repartition(*key).sortWithinPartitions(*key, "at", "id").mapInArrow(pack, _VECTOR)


class _Block:
    """Unpacked counts of a block's groups in a shard."""

    def __init__(self, row: dict) -> None:
        self.sources, self.terms, self.here = row["sources"], row["terms"], row["here"]
        step, n = _unpack(row["counts"], 2)
        self.at, self.id = np.divmod(np.cumsum(step), max(self.here, 1))
        self.n, self.totals = n, row["totals"]
        if self.terms:
            self.none = np.array([shares(np.zeros(1), t, self.terms)[0] for t in self.totals])
            self.share = np.concatenate([shares(n[self.at == i], t, self.terms) for i, t in enumerate(self.totals)] or [n])

    def over(self, ids: np.ndarray) -> np.ndarray:
        """Shares of each group for the terms ids, which hold all of the block's."""
        out = np.repeat(self.none[:, None], len(ids), 1)
        out[self.at, np.searchsorted(ids, self.id)] = self.share
        return out


def _met(a: _Block, b: _Block) -> Iterator[tuple[str, str, int]]:
    """(source, peer, value) of each group of a and each of b in both directions; of each two groups where a is b. Terms that
    neither block holds count by the shares of zero."""
    ids = np.unique(np.concatenate([a.id, b.id]))
    if a.terms:
        x, y = a.over(ids), b.over(ids)
    for i, s in enumerate(a.sources):
        for j, t in enumerate(b.sources):
            if a is b and j <= i:
                continue
            value = 0
            if a.terms:
                value = int(distance(x[i], y[j]).sum()) + (a.here - len(ids)) * int(distance(a.none[i], b.none[j]))
            yield s, t, value
            yield t, s, value


def _highest(own: _Block, row: dict, top: int) -> Iterator[tuple[str, str, int]]:
    """(source, term, value) of the top terms of each group in the shard whose share is above the language's."""
    if not own.terms:
        return
    q = shares(_unpack(row["overall"], 1)[0], row["total"], own.terms)
    value = np.where(own.share > q, distance(own.share, q), -1)
    for i, s in enumerate(own.sources):
        mine = np.flatnonzero((own.at == i) & (value >= 0))
        if len(mine) > top:  # all that reach the value of the last place: ties are settled by their bytes
            mine = mine[value[mine] >= np.partition(value[mine], len(mine) - top)[len(mine) - top]]
        for v, w in sorted((-int(value[k]), row["words"][k].encode()) for k in mine)[:top]:
            yield s, w.decode(), -v


def _tournament(vectors: DataFrame, top: int) -> DataFrame:
    """lang, source, part, item, value of each shard: pairs from the meetings, terms from each block's own visit at home."""
    blocks, block = F.col("blocks"), F.col("block")
    rounds = F.sequence(F.lit(0), blocks + blocks % 2 - 2)
    away = vectors.where("blocks > 1").withColumn("round", F.explode(rounds)).withColumn("home", opponent(block, F.col("round"), blocks))
    at_home = F.when((F.col("home") + block) % 2 == 1, F.col("home") < block).otherwise(F.col("home") > block)  # half of the meetings each
    nothing = (F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("binary").alias("overall"))
    away = away.where((F.col("home") < blocks) & at_home).select("lang", "shard", "home", "round", "terms", "total", "here", "sources", "totals", "counts", *nothing)
    own = vectors.select("lang", "shard", block.alias("home"), F.lit(-1).alias("round"), "terms", "total", "here", "sources", "totals", "counts", "words", "overall")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: _Block | None = None
        for b in batches:
            for i in range(b.num_rows):  # a row is a block of groups
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                block = _Block(row)
                if row["round"] < 0:
                    home = block
                    found = [(s, "pair", t, v) for s, t, v in _met(block, block)] + [(s, "term", t, v) for s, t, v in _highest(block, row, top)]
                else:
                    found = [(s, "pair", t, v) for s, t, v in _met(home, block)]
                if found:
                    s, part, item, value = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(found), pa.string()), pa.array(s, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    key = ["lang", "shard", "home"]
    return own.unionByName(away).repartition(*key).sortWithinPartitions(*key, "round").mapInArrow(meet, "lang string, source string, part string, item string, value bigint")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: each other source of the language and the sum of distances of all kept
    terms. Part term: the top terms of the group above its language's share, with their distance."""
    filled = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = C.stored(count_terms(filled), "terms")
    groups = filled.select("lang", "source").distinct()
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("overall")).where(F.col("docs") >= min_docs)
    shard = F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int").alias("shard")
    number = F.row_number().over(W.partitionBy("lang", "shard").orderBy("term")) - 1
    kept = C.stored(kept.select("lang", "term", "overall", shard).withColumn("id", number.cast("bigint")), "kept")

    sizes = kept.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("here"), F.sum("overall").alias("_n"))
    langs = sizes.groupBy("lang").agg(F.sum("here").alias("terms"), F.sum("_n").alias("total"))
    entries = counted.join(kept, ["lang", "term"]).select("lang", "source", "shard", "id", "n", "overall", "term")
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1  # one row a group
    blocks = F.ceil(F.count(F.lit(1)).over(W.partitionBy("lang")) / BLOCK).cast("int")
    dealt = groups.withColumn("_at", place).withColumn("blocks", blocks).select("lang", "source", F.floor(F.col("_at") / BLOCK).cast("int").alias("block"), (F.col("_at") % BLOCK).alias("at"), "blocks")
    dealt = C.stored(dealt.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "terms", "total"]), "groups")

    heads = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)))).join(sizes.drop("_n"), ["lang", "shard"], "left").na.fill(0, ["here"])
    heads = heads.select("*", F.lit(-1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("overall"), F.lit(None).cast("string").alias("term"))
    body = entries.join(dealt.drop("n", "blocks", "terms", "total"), ["lang", "source"]).select("*", *(F.lit(0).cast(k).alias(c) for c, k in (("blocks", "int"), ("terms", "bigint"), ("total", "bigint"), ("here", "bigint"))))
    vectors = C.stored(_vectors(heads.unionByName(body)), "vectors")
    sums = _tournament(vectors, top).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
k AS (SELECT lang, term, sum(n)::HUGEINT AS overall FROM t GROUP BY 1, 2 HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(overall)::HUGEINT AS total FROM k GROUP BY 1),
e AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0)::HUGEINT AS n, overall FROM g JOIN k ON g.lang = k.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS own FROM e),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (own + 2 * v) AS p, 1 + 1000000000::HUGEINT * (overall + 2) // (total + 2 * v) AS q FROM s JOIN l USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM o) WHERE part = 'pair' OR rank <= 10"""
