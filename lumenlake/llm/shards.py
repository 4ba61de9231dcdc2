"""Training-order materialisation: token ids in fixed-stride binary shards, in a keyed pseudo-random order.

Texts become token ids of a public vocabulary with an end id after each. Each task packs its texts into sequences of fixed
length without gaps, so a sequence may hold several texts or part of one, and only the last one of a task is partly empty.
Sequences are numbered (a count for each stored part, then a running sum over the parts), and a keyed Feistel permutation of
the numbers, walked along its cycles until it falls inside the range, gives every sequence its global slot: an order that
needs no sort key to be stored and can be recomputed from the key. Each partition takes a range of slots and writes
it, shard by shard, as files of `per_shard` sequences of `stride` bytes, so slot s lies in shard s // per_shard at (s % per_shard) * stride
and a reader can go on from any slot. A shard is written under a name of its own and renamed, so tasks that run twice do no
harm.

Defined cases: null and empty texts are an end id alone; repeated rows are written each; a text goes on in the next `seq` of
its `stream`; the last sequence of a stream is padded with PAD; an empty table writes no shard; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END, PAD = 50256, 65535
#: Most partitions of slots; beyond it a partition holds more shards, which it writes one after the other.
MOST_RANGES = 20_000
#: How byte-level vocabularies cut a text before merging (a fixed value of the public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
@lru_cache(maxsize=2)
def _encoding(raw: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A text is encoded in pieces of at least so many characters, cut before a space, where the pattern cuts too.
PIECE = 100_000


def encode(text: str, raw: bytes) -> np.ndarray:
    """The ids of a text and END."""
    enc, ids, lo = _encoding(raw), [], 0
    while len(text) - lo > PIECE:
        hi = lo + PIECE
        while hi < len(text) and not (text[hi] == " " and not text[hi - 1].isspace()):
            hi += 1
        ids += enc.encode_ordinary(text[lo:hi])
        lo = hi
    return np.array([*ids, *enc.encode_ordinary(text[lo:]), END], np.uint16)


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The place of each index in a keyed permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = C.mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):  # walk along the cycle until the place is inside
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (C.mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int, vocabulary: str) -> DataFrame:
    """stream, seq, doc_ids (of the texts in it, in their order), n_tokens, tokens: the packed sequences, stored."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size

    def cut(ids: np.ndarray, owner: np.ndarray, names: list, stream: int, seq: int) -> pa.RecordBatch:
        n = -(-len(ids) // length)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]) | (np.arange(len(ids)) % length == 0))
        bounds = np.searchsorted(starts, np.arange(n + 1) * length)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array([names[i] for i in owner[starts]], pa.int64()))
        raw = ids.astype("<u2").tobytes()
        blobs = [raw[2 * length * i : 2 * length * (i + 1)] for i in range(n)]
        return pa.record_batch([pa.array(np.full(n, stream), pa.int64()), pa.array(np.arange(seq, seq + n)), lists, pa.array([len(b) // 2 for b in blobs], pa.int64()), pa.array(blobs, pa.binary())], ["stream", "seq", "doc_ids", "n_tokens", "tokens"])

    def rows(batches):
        stream, seq = TaskContext.get().partitionId(), 0
        ids, owner, names = np.zeros(0, np.uint16), np.zeros(0, np.int64), []
        for b in batches:
            texts = b.column("text")
            for lo in range(0, len(texts), 200):
                made = [encode(t.as_py() or "", shared.value) for t in texts.slice(lo, 200)]
                owner = np.concatenate([owner, len(names) + np.repeat(np.arange(len(made)), [len(x) for x in made])])
                ids = np.concatenate([ids, *made])
                names += b.column("doc_id").slice(lo, 200).to_pylist()
                whole = len(ids) // length * length
                if whole:
                    yield cut(ids[:whole], owner[:whole], names, stream, seq)
                seq += whole // length
                ids, owner = ids[whole:], owner[whole:]
                first = int(owner[0]) if len(owner) else len(names)
                names, owner = names[first:], owner - first
        if len(ids):
            yield cut(ids, owner, names, stream, seq)

    return C.stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "stream long, seq long, doc_ids array<long>, n_tokens long, tokens binary"), "sequences")


def materialise(docs: DataFrame, length: int = 512, per_shard: int = 4096, key: int = 20240229, vocabulary: str = VOCABULARY, out: str | None = None, stored: bool = True) -> tuple[DataFrame, str, int]:
    """With stored=False the shards are written as the rows are first read, and again, alike, whenever they are read anew.

    (one row for each sequence: doc_ids, stream, seq, slot, shard, offset, n_tokens, tokens_sha256; folder; number of sequences)."""
    spark = docs.sparkSession
    out = out or f"{C.shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    stride = 2 * length
    seqs = sequences(docs, length, vocabulary)
    parts = seqs.groupBy("stream").agg(F.max("seq").alias("n")).toArrow().sort_by("stream")  # one row for each task that wrote
    number = parts.column("n").to_numpy() + 1
    starts = dict(zip(parts.column("stream").to_pylist(), (np.cumsum(number) - number).tolist(), strict=True))
    total = int(number.sum())
    shared = spark.sparkContext.broadcast(starts)

    def place(batches):
        for b in batches:
            of, where = np.unique(b.column("stream").to_numpy(), return_inverse=True)
            slot = feistel(np.array([shared.value[x] for x in of.tolist()], np.int64)[where] + b.column("seq").to_numpy(), total, key)
            order = np.argsort(slot)
            slot, part = slot[order], b.take(pa.array(order))
            cut = np.flatnonzero(np.concatenate([[True], np.diff(slot // per_shard) > 0, [True]])).astype(np.int32)
            raw = [t.as_py().ljust(stride, b"\xff") for t in part.column("tokens")]
            packed = [codec().compress(b"".join(raw[i:j]), asbytes=True) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch(
                [pa.array(slot[cut[:-1]] // per_shard), *(pa.ListArray.from_arrays(pa.array(cut), x) for x in (pa.array(slot), *(part.column(c) for c in ("stream", "seq", "doc_ids", "n_tokens")))), pa.array(packed, pa.binary())],
                ["shard", "slot", "stream", "seq", "doc_ids", "n_tokens", "tokens"],
            )

    def codec():
        return pa.Codec("zstd", compression_level=5)

    # The sequences of a batch that go to one shard travel as one compressed row.
    placed = seqs.mapInArrow(place, "shard long, slot array<long>, stream array<long>, seq array<long>, doc_ids array<array<long>>, n_tokens array<long>, tokens binary")
    # Slots are uniform over 0..total-1, so the bounds of equal ranges are known without a sample: each partition takes a run
    # of shards.
    shards = max(1, -(-total // per_shard))
    ranges = min(shards, MOST_RANGES)
    placed = placed.repartitionById(ranges, F.floor(F.col("shard") * ranges / shards).cast("int")).sortWithinPartitions("shard")

    def write(batches):
        fs, base = pa.fs.FileSystem.from_uri(out if "://" in out or out.startswith("file:") else f"file://{out}")
        fs.create_dir(base, recursive=True)
        shard, body = None, None

        def close():
            name = f"{base}/shard-{shard:08d}.bin"
            own = f"{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own, compression=None) as f:
                f.write(body)
            fs.move(own, name)

        for b in batches:
            for i, s in enumerate(b.column("shard").to_pylist()):
                if s != shard:
                    if shard is not None:
                        close()
                    shard, body = s, bytearray(b"\xff" * (stride * min(per_shard, total - s * per_shard)))
                meta = {c: b.column(c).slice(i, 1).flatten() for c in ("doc_ids", "stream", "seq", "slot", "n_tokens")}
                at = meta["slot"].to_numpy() % per_shard * stride
                raw = memoryview(codec().decompress(b.column("tokens")[i].as_py(), len(at) * stride, asbytes=True))
                hashes = []
                for j, (lo, n) in enumerate(zip(at.tolist(), meta["n_tokens"].to_pylist(), strict=True)):
                    one = raw[j * stride : (j + 1) * stride]
                    body[lo : lo + stride] = one
                    hashes.append(hashlib.sha256(one[: 2 * n]).hexdigest())
                yield pa.record_batch([meta["doc_ids"], meta["stream"], meta["seq"], meta["slot"], pa.array(np.full(len(at), s)), pa.array(at), meta["n_tokens"], pa.array(hashes, pa.string())], ["doc_ids", "stream", "seq", "slot", "shard", "offset", "n_tokens", "tokens_sha256"])
        if shard is not None:
            close()

    done = placed.mapInArrow(write, "doc_ids array<long>, stream long, seq long, slot long, shard long, offset long, n_tokens long, tokens_sha256 string")
    return C.stored(done, "index") if stored else done, out, total


def read_from(folder: str, slot: int, length: int = 512, per_shard: int = 4096) -> Iterator[np.ndarray]:
    """Sequences in training order from a slot on; padding is left out."""
    fs, base = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    shard = slot // per_shard
    while fs.get_file_info(f"{base}/shard-{shard:08d}.bin").type == pa.fs.FileType.File:
        with fs.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek((slot % per_shard) * 2 * length if shard == slot // per_shard else 0)
            while raw := f.read(2 * length):
                t = np.frombuffer(raw, "<u2")
                yield t[t != PAD]
        shard += 1
        slot = shard * per_shard
