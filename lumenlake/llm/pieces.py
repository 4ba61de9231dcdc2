"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The pieces come from a public model file (a parameter; read by a small reader of the few protobuf fields needed, never
trained). The file's scores are merge ranks of a BPE model, not log probabilities; a piece of rank r gets the Zipf log score
-log(r + SHIFT) less the normaliser, which the Viterbi search maximises in total.

White space: every space becomes the marker U+2581, one marker is put before the text. No piece holds a marker after another
character, so the best path of a text is that of its chunks (markers, then what follows up to the next marker), and each
distinct chunk of a task's block is solved once, all chunks side by side in numpy. Characters without a piece fall back to
the byte pieces <0x00>..<0xFF>. Decoding joins pieces and bytes, turns markers into spaces and drops the first one.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows are encoded alike; any valid
text without U+2581 itself decodes to itself exactly (a U+2581 of the text comes back as a space, as the format has it).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C

MARKER = "▁".encode()
SHIFT = 10.0
#: A byte piece costs more than any other piece, as an unknown character does.
BYTE_PENALTY = 10.0
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        i += 1
        if b[i - 1] < 128:
            return out, i
        shift += 7


def _fields(b: bytes):
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_pieces(raw: bytes) -> tuple[list[bytes], list[int]]:
    """(pieces, kinds) of a model file; kinds as in the format: 1 normal, 2 unknown, 3 control, 6 byte."""
    pieces, kinds = [], []
    for field, value in _fields(raw):
        if field == 1:
            f = dict(_fields(value))
            pieces.append(f[1])
            kinds.append(f.get(3, 1))
    return pieces, kinds


class DoubleArray:
    """A trie of byte strings in two arrays: the child of state s by byte c is base[s] + c, if check says so."""

    def __init__(self, words: list[tuple[bytes, int]]):
        words = sorted(words)
        n = 1 << 16
        self.base, self.check, self.value = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.check[0] = 0
        free, crowded, stack = 1, 1, [(0, 0, len(words), 0)]
        while stack:
            state, lo, hi, depth = stack.pop()
            if lo < hi and len(words[lo][0]) == depth:
                self.value[state] = words[lo][1]
                lo += 1
            if lo == hi:
                continue
            runs: list[tuple[int, int]] = []
            for i in range(lo, hi):
                c = words[i][0][depth]
                if not runs or runs[-1][0] != c:
                    runs.append((c, i))
            codes = np.array([c for c, _ in runs]) + 1
            while self.check[free] != -1:
                free += 1
            at, lowest = -1, free if len(codes) == 1 else max(free, crowded)
            while at < 0:  # the first place from here on where all children find a free cell
                while lowest + 1024 + 260 >= len(self.check):
                    grow = len(self.check)
                    self.base, self.check, self.value = np.append(self.base, np.zeros(grow, np.int32)), np.append(self.check, np.full(grow, -1, np.int32)), np.append(self.value, np.full(grow, -1, np.int32))
                open_at = lowest + np.flatnonzero(self.check[lowest : lowest + 1024] == -1) - codes[0]
                open_at = open_at[open_at >= 0]
                fits = (self.check[open_at[:, None] + codes] == -1).all(1)
                if fits.any():
                    at = int(open_at[fits.argmax()])
                elif len(codes) < 4:
                    crowded = lowest + 512
                lowest += 1024
            self.base[state] = at
            self.check[at + codes] = state
            ends = [i for _, i in runs[1:]] + [hi]
            stack += [(at + c + 1, i, e, depth + 1) for (c, i), e in zip(runs, ends, strict=True)]
        used = int(np.flatnonzero(self.check >= 0).max()) + 260
        self.base, self.check, self.value = self.base[:used].copy(), self.check[:used].copy(), self.value[:used].copy()

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children of states by bytes; -1 where there is none."""
        to = self.base[state] + byte + 1
        return np.where((state >= 0) & (to < len(self.check)) & (self.check[np.minimum(to, len(self.check) - 1)] == state), to, -1)


class Pieces:
    def __init__(self, raw: bytes):
        self.pieces, self.kinds = read_pieces(raw)
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.first_byte = np.array([self.bytes_at[b] for b in range(256)], np.int32)
        normal = [i for i, k in enumerate(self.kinds) if k in (1, 4)]
        total = math.log(sum(1 / (r + SHIFT) for r in range(len(normal))))
        self.score = np.full(len(self.pieces), -np.inf)
        self.score[normal] = [-math.log(r + SHIFT) - total for r in range(len(normal))]
        self.byte_score = float(self.score[normal].min()) - BYTE_PENALTY
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.trie = DoubleArray([(self.pieces[i], i) for i in normal])
        self.surface = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else p for p, k in zip(self.pieces, self.kinds, strict=True)]

    def encode_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The best ids of each chunk. Chunks of like length are solved together; ties go to the longer last piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(chunks)
        length = np.array([len(c) for c in chunks], np.int64)
        order = np.argsort(length, kind="stable")
        i = int(np.searchsorted(length[order], 1))
        while i < len(order):
            n = int(length[order[i]])
            # A group's arrays hold (longest - shortest) no more than a third and about a million cells.
            j = min(int(np.searchsorted(length[order], n + n // 3, "right")), i + max(1, 1_000_000 // n))
            self._group(chunks, order[i:j], int(length[order[j - 1]]), length, out)
            i = j
        return out

    def _group(self, chunks: list[bytes], group: np.ndarray, top: int, length: np.ndarray, out: list[np.ndarray]) -> None:
        k = len(group)
        text = np.frombuffer(b"".join(chunks[i].ljust(top, b"\0") for i in group), np.uint8).reshape(k, top).astype(np.int32)
        n = length[group]
        best = np.full((top + 1, k), -np.inf)
        best[0] = 0
        piece, back = np.full((top + 1, k), -1, np.int32), np.zeros((top + 1, k), np.int32)
        lead = (text & 0xC0) != 0x80
        for s in range(top):
            rows = np.flatnonzero((n > s) & lead[:, s] & (best[s] > -np.inf))
            if not len(rows):
                continue
            from_score = best[s, rows]
            # Where the character at s is not a piece, its bytes are.
            wide = np.ones(len(rows), np.int64)
            for e in range(s + 1, min(s + 4, top)):
                wide += (wide == e - s) & ~lead[rows, e] & (n[rows] > e)
            alone = np.zeros(len(rows), bool)
            state, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for e in range(s, min(top, s + self.longest)):
                live = live[n[rows[live]] > e]
                if not len(live):
                    break
                to = self.trie.step(state[live], text[rows[live], e])
                live = live[to >= 0]
                to = to[to >= 0]
                state[live] = to
                at = self.trie.value[to]
                hit = at >= 0
                if hit.any():
                    r, p = live[hit], at[hit]
                    alone[r] |= wide[r] == e + 1 - s
                    total = from_score[r] + self.score[p]
                    better = total > best[e + 1, rows[r]]
                    r, p, total = r[better], p[better], total[better]
                    best[e + 1, rows[r]], piece[e + 1, rows[r]], back[e + 1, rows[r]] = total, p, s
            bare = np.flatnonzero(~alone)
            for w in np.unique(wide[bare]):
                r = bare[wide[bare] == w]
                total = from_score[r] + self.byte_score * w
                better = total > best[s + w, rows[r]]
                r = rows[r[better]]
                best[s + w, r], piece[s + w, r], back[s + w, r] = total[better], -1, s
        for col, i in enumerate(group):
            ids: list[int] = []
            e = int(n[col])
            while e:
                s = int(back[e, col])
                p = int(piece[e, col])
                ids += [p] if p >= 0 else [self.bytes_at[x] for x in reversed(chunks[i][s:e])]
                e = s
            out[i] = np.array(ids[::-1], np.int32)

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each row in them) of a block of texts."""
        w = C.split(data, bounds, lower=False, space=b" ", lead=True)
        # The first chunk of a text has one marker more; so chunks are told apart by hash and by being first.
        first = np.concatenate([[True], w.row[1:] != w.row[:-1]]) if len(w.row) else np.zeros(0, bool)
        _, index, inverse = np.unique(w.hash ^ first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
        chunks = [(MARKER if first[i] else b"") + w.at(i).replace(b" ", MARKER) for i in index]
        ids = self.encode_chunks(chunks)
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        start = np.concatenate([[0], np.cumsum(size)])
        each = size[inverse]
        out = flat[np.repeat(start[inverse] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())] if len(inverse) else flat
        per = np.bincount(w.row, each, minlength=w.rows).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per)])

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join([self.surface[i] for i in ids.tolist()]).replace(MARKER, b" ")
        return text[1:] if text[:1] == b" " else text


@lru_cache(maxsize=2)
def _model(path: str) -> Pieces:
    """The vocabulary and its trie, built once on the driver and sent to the tasks: of the size of the vocabulary file."""
    with open(path, "rb") as f:
        return Pieces(f.read())


def encode_docs(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of docs and ids: array of piece ids of text."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(_model(model))
    names = docs.columns

    def rows(batches):
        sp = shared.value
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column(len(names))):
                ids, at = sp.encode_block(data, bounds)
                part = b.slice(lo, hi - lo)
                yield pa.record_batch([*(part.column(i) for i in range(len(names))), C.lists(ids, at, pa.int32())], schema=out)

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    return docs.select("*", docs["text"].cast("string").cast("binary").alias("_bytes")).mapInArrow(rows, schema)


def decode_docs(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with decoded: the text of ids; null ids are the empty text."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = encoded.sparkSession.sparkContext.broadcast(_model(model))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    out = to_arrow_schema(schema)
    at = encoded.columns.index("ids")

    def rows(batches):
        sp = shared.value
        for b in batches:
            text = [sp.decode(np.asarray(x, np.int32)).decode("utf-8", "replace") if x else "" for x in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(text, pa.string())], schema=out)

    return encoded.mapInArrow(rows, schema)


def roundtrip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, n_bytes (ids of byte pieces), ids_sha256 (of the ids as little-endian int32), decoded_sha256 and exact
    (whether decoding gives the text back), for each row; the ids themselves do not leave the task."""
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(_model(model))

    def rows(batches):
        sp = shared.value
        low, high = int(sp.first_byte.min()), int(sp.first_byte.max())
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                ids, at = sp.encode_block(data, bounds)
                byte = np.concatenate([[0], np.cumsum((ids >= low) & (ids <= high))])
                one, two, same = [], [], []
                for r in range(hi - lo):
                    x = ids[at[r] : at[r + 1]]
                    text = sp.decode(x)
                    one.append(hashlib.sha256(x.astype("<i4").tobytes()).hexdigest())
                    two.append(hashlib.sha256(text).hexdigest())
                    same.append(text == data[bounds[r] : bounds[r + 1]].tobytes())
                yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(byte[at[1:]] - byte[at[:-1]]), pa.array(one), pa.array(two), pa.array(same)], ["doc_id", "n_ids", "n_bytes", "ids_sha256", "decoded_sha256", "exact"])

    return docs.select(F.col("doc_id").cast("long"), C.byte_texts(docs)).mapInArrow(rows, "doc_id long, n_ids long, n_bytes long, ids_sha256 string, decoded_sha256 string, exact boolean")
