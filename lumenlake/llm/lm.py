"""Language-model scoring with a causal self-attention model in numpy over subword ids.

A masked self-attention layer reads the words before a place (each the mean of the embeddings of its subword ids) and predicts
the class of the next word; a word's class follows from its subword ids alone: the group of texts whose ids are most like
them, and the frequency band of the first. The same layer weighs three kinds of probability of the next word:

    p(word) = w0 * base + w1 * P(class | attention) * base / B(class) + sum over k of v_k * p_k(its ids, word end)

base = (c + 0.1) / (N + 0.1 (V + 1)); B(class) is the sum of base over the class's words; p_k is a table of the subword ids
that follow a class of ids in group k of texts. Counts, tables and groups (k-means) come from all learning texts. Windows of
WINDOW words overlap by WINDOW - STEP; each word is scored once, with the words before it in its window.

The layer is trained by Adam on replicas, one for each of at most `replicas` tasks, over every learning text (with every > 1,
over one fold in `every`), and averaged. Word counts are a table: the most frequent words, TABLE at most, are sent to the
tasks, all others are joined by hash, in training and in scoring; where a word's counts lie does not change its probability.

Defined cases: null and empty texts are an end alone; rows that repeat are scored alike; null doc_ids teach nothing and have a
null held_out; with no learning text the counts are 0 and the model is the base.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C
from lumenlake.llm import langid
from lumenlake.llm.shards import VOCABULARY, _encoding

EXPERTS, PREVIOUS, DIM, BINS = 6, 16, 16, 2048
#: Frequency bands of a word's first id; classes of words.
BANDS = 6
CLASSES = EXPERTS * BANDS
#: A window is the STEP places that are scored and the STEP before them.
WINDOW, STEP = 32, 16
#: Windows of a step of the training.
BATCH = 128
END_OF_WORD, END_OF_TEXT, IDS = 50256, 50257, 50258
NEWLINE = 198
#: Values beyond it are no longer taken to exp as they are.
FAR = 60
#: Products of queries and keys are made smaller by it.
SHRINK = np.float32(1 / np.sqrt(DIM))
#: A word's ids that are added one after the other; those beyond are summed by word.
FEW = 4
#: Words sent to the tasks, at most: 56 bytes each, and 4 for each of a word's ids.
TABLE = 500_000
#: Tokens of all texts for which there is one more replica.
REPLICA = 300_000
#: Words whose ids a task keeps, at most.
KEPT = 200_000
#: The hash of the token that ends a text.
END = np.uint64(0xE0F0E0F0E0F0E0F1)


@dataclass
class Tokens:
    """The tokens of a block in reading order, an end after each row: index of the distinct word of each, bounds of the rows."""

    hash: np.ndarray
    inverse: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    #: Where a table has each distinct word; -1: nowhere. None: there is no table.
    known: np.ndarray | None = None

    @cached_property
    def closed(self) -> np.ndarray:
        """Whether END_OF_WORD is the last id of each distinct word."""
        return self.ids[self.at[1:] - 1] == END_OF_WORD

    @cached_property
    def inner(self) -> np.ndarray:
        """The number of ids of each distinct word without that one."""
        return np.diff(self.at) - self.closed

    @cached_property
    def share(self) -> np.ndarray:
        return 1 / np.diff(self.at).astype(np.float32)

    def some(self, words: np.ndarray) -> Tokens:
        """These distinct words alone."""
        size = np.diff(self.at)[words]
        return Tokens(self.hash[words], np.arange(len(words)), np.array([0, len(words)]), self.ids[_runs(self.at[:-1][words], size)], np.append(0, np.cumsum(size)))


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1 ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _where(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash; -1: it has none."""
    if not len(sorted_):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return np.where(sorted_[at] == h, at, -1)


def hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[C.Words, np.ndarray, np.ndarray]:
    """(words, the hashes with each row's end put in, bounds of the rows)."""
    w = C.split(data, bounds)
    per = w.per_row()
    out = np.full(len(w.hash) + len(per), END, np.uint64)
    out[np.arange(len(w.hash)) + w.row] = w.hash
    return w, out, np.concatenate([[0], np.cumsum(per + 1)])


#: Words that a task has met: hashes in order, where the ids of each begin in the last array, how many they are, the ids.
_NONE = (np.array([END], np.uint64), np.array([0]), np.array([1]), np.array([END_OF_TEXT], np.int32))
_met = _NONE


def _encoded(words: list[bytes], raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of the words, END_OF_WORD after each, how many each has)."""
    enc = _encoding(raw)
    ids = enc.encode_to_numpy((b"\n".join(words) + b"\n").decode("utf-8", "replace"), disallowed_special=()).astype(np.int32)  # no word holds a line break
    ends = np.flatnonzero(ids == NEWLINE)
    if len(ends) == len(words):
        ids[ends] = END_OF_WORD
        return ids, np.diff(ends, prepend=-1)
    parts = [(*enc.encode_ordinary(x.decode("utf-8", "replace")), END_OF_WORD) for x in words]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(itertools.chain.from_iterable(parts), np.int32, int(size.sum())), size


def word_ids(hash: np.ndarray, words: Callable[[np.ndarray], list[bytes]], raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of distinct words and END_OF_WORD after each, bounds of each word's). words gives the bytes of those at some
    places; it is asked for words only that the task has not met, and never for the end of a text."""
    global _met
    known, first, size, pool = _met
    fresh = np.flatnonzero(known[np.minimum(np.searchsorted(known, hash), len(known) - 1)] != hash)
    if len(fresh):
        ids, n = _encoded(words(fresh), raw)
        known, first, size = np.append(known, hash[fresh]), np.append(first, len(pool) + np.cumsum(n) - n), np.append(size, n)
        order, pool = np.argsort(known, kind="stable"), np.append(pool, ids)
        known, first, size = known[order], first[order], size[order]
        _met = (known, first, size, pool) if len(known) <= KEPT else _NONE
    at = np.searchsorted(known, hash)
    return pool[_runs(first[at], size[at])].astype(np.int64), np.append(0, np.cumsum(size[at]))


def tokens(data: np.ndarray, bounds: np.ndarray, raw: bytes, table: LanguageModel | None = None) -> Tokens:
    """The ids of words that the table has are taken from there."""
    w, h, rows = hashes(data, bounds)
    u, inverse = np.unique(h, return_inverse=True)
    where = np.full(len(u), -1, np.int64)
    where[inverse[np.arange(len(w.hash)) + w.row]] = np.arange(len(w.hash))
    text = w.data.tobytes()

    def words(some: np.ndarray) -> list[bytes]:
        return [text[a:z] for a, z in zip(w.start[where[some]].tolist(), w.end[where[some]].tolist(), strict=True)]

    if table is None:
        return Tokens(u, inverse, rows, *word_ids(u, words, raw))
    known = _where(table.h, u)
    hit, rest = np.flatnonzero(known >= 0), np.flatnonzero(known < 0)
    others, at = word_ids(u[rest], lambda some: words(rest[some]), raw)
    size = np.empty(len(u), np.int64)
    size[hit], size[rest] = np.diff(table.at)[known[hit]], np.diff(at)
    ends = np.cumsum(size)
    ids = np.empty(ends[-1] if len(ends) else 0, np.int64)
    ids[_runs((ends - size)[hit], size[hit])] = table.ids[_runs(table.at[:-1][known[hit]], size[hit])]
    ids[_runs((ends - size)[rest], size[rest])] = others
    return Tokens(u, inverse, rows, ids, np.append(0, ends), known)


def cells(t: Tokens) -> np.ndarray:
    """For each id of each distinct word: class of the id before it, and the id."""
    before = np.zeros(len(t.ids), np.int64)
    before[1:] = 1 + t.ids[:-1] % (PREVIOUS - 1)
    before[t.at[:-1]] = 0
    return before * IDS + t.ids


class Layer:
    """Masked self-attention over embeddings of hashed subword ids; parameters in one vector."""

    KINDS = EXPERTS + 2
    SHAPES = [(BINS, DIM), (DIM, DIM), (DIM, DIM), (DIM, DIM), (DIM, DIM), (DIM, DIM), (DIM, KINDS), (KINDS,), (DIM, CLASSES), (CLASSES,)]
    SIZES = [int(np.prod(s)) for s in SHAPES]
    SPANS = list(zip(itertools.accumulate([0, *SIZES]), itertools.accumulate(SIZES), SHAPES))
    MASK = np.where(np.arange(WINDOW) <= np.arange(STEP)[:, None] + WINDOW - STEP, np.float32(0), np.float32(-1e9))

    def __init__(self, vector: np.ndarray | None = None):
        rng = np.random.default_rng(7)
        if vector is None:
            vector = rng.standard_normal(sum(self.SIZES)) * 0.25
            parts = self.parts(vector)
            parts[7][:] = [0.0, 1.0] + [-2.0] * EXPERTS
            parts[9][:] = 0
        self.vector = vector.astype(np.float32)

    def parts(self, v: np.ndarray) -> list[np.ndarray]:
        return [v[a:z].reshape(s) for a, z, s in self.SPANS]

    def embed(self, t: Tokens) -> np.ndarray:
        return self._means(t, np.arange(len(t.hash)))

    def embed_of(self, t: Tokens, place: np.ndarray) -> np.ndarray:
        """embed(t), filled in only for the words before these places."""
        u = np.unique(t.inverse[np.clip(place - 1, 0, len(t.inverse) - 1)])
        out = np.empty((len(t.hash), DIM), np.float32)
        out[u] = self._means(t, u)
        return out

    def _means(self, t: Tokens, u: np.ndarray) -> np.ndarray:
        return self.embedded(Places(t, u[:, None]))[:, 0]

    def embedded(self, places: Places) -> np.ndarray:
        """The mean of the embeddings of the ids of the word at each of these places, 0 where there is none: the first ids of all
        are added, the second of all, and so on."""
        e = self.parts(self.vector)[0]
        padded = np.concatenate([e, np.zeros((1, DIM), np.float32)])
        out = places.closed[..., None] * e[END_OF_WORD % BINS]
        for bins in places.few:
            out += padded[bins]
        at = np.flatnonzero(places.size.reshape(-1) > FEW)
        if len(at):
            n = places.size.reshape(-1)[at] - FEW
            out.reshape(-1, DIM)[at] += np.add.reduceat(e[places.ids[_runs(places.first[at] + FEW, n)]], np.cumsum(n) - n)
        out *= places.share[..., None]
        return out

    def forward(self, z: np.ndarray, valid: np.ndarray, attend: bool = True) -> tuple:
        """z: (windows + 1, STEP, DIM) of the words before each place, each place once. Of the last STEP places of each window: the
        weight of each kind, the probability of each class, and what backward needs. attend=False leaves the attention out."""
        _, wq, wk, wv, wz, wo, g, g0, u, u0 = self.parts(self.vector)
        made = _times(z, np.concatenate([wk, wv, wq * SHRINK, wz], 1))
        kv = np.lib.stride_tricks.as_strided(made, (len(z) - 1, WINDOW, 2 * DIM), made.strides, writeable=False)  # a window's keys: STEP of the one before, and its own
        q, k, v = made[1:, :, 2 * DIM : 3 * DIM], kv[..., :DIM], kv[..., DIM:]
        s = q @ k.transpose(0, 2, 1)
        far = s.size and max(s.max(), -s.min()) > FAR
        s += self.MASK
        part = np.flatnonzero(~valid.all(1))
        s[part] += np.where(valid[part], np.float32(0), np.float32(-1e9))[:, None, :]
        if far:
            s -= s.max(2, keepdims=True)
        np.exp(s, s)
        inverse = 1 / _times(s, np.ones((WINDOW, 1), np.float32))  # the shares of the keys are s * inverse
        o = s @ v if attend else np.zeros_like(q)
        o *= inverse
        h = _times(o, wo)
        h += made[1:, :, 3 * DIM :]
        np.tanh(h, h)
        weights, bias = np.concatenate([g, u], 1), np.concatenate([g0, u0])
        x = _times(h, weights)
        x += bias
        sides = x[..., : self.KINDS], x[..., self.KINDS :]
        if (np.abs(weights).sum(0) + np.abs(bias)).max() > FAR:  # h lies between -1 and 1
            for side in sides:
                _softmax(side)
        else:
            np.exp(x, x)
            for side in sides:
                side *= 1 / _times(side, np.ones((side.shape[-1], 1), np.float32))
        return *sides, (x, q, k, v, s, inverse, o, h)

    def gradient(self, z: np.ndarray, valid: np.ndarray, scored: np.ndarray, p: np.ndarray, kind: np.ndarray, words: Places, t: Tokens) -> np.ndarray:
        """Of the mean negative log probability of the word, plus that of its class, at the scored places of the last STEP. p: the probability of the word there
        of each kind, that of the second given its class; kind: that class."""
        _, wq, wk, wv, wz, wo, g, _, u, _ = self.parts(self.vector)
        w, y, (dxy, q, k, v, s, inverse, o, h) = self.forward(z, valid)
        flat = lambda x: x.reshape(-1, x.shape[-1])
        row, kind = np.arange(kind.size), kind.reshape(-1)
        here = flat(dxy)[row, self.KINDS + kind][:, None]
        r = flat(w * p)
        r[:, 1:2] *= here
        r /= np.maximum(r @ np.ones((self.KINDS, 1), np.float32), np.float32(1e-30))
        scale = (scored.reshape(-1, 1) / max(1, scored.sum())).astype(np.float32)
        grown = (1 + r[:, 1:2]) * scale
        dxy = flat(dxy)  # w and y become the slopes of what they come from
        dxy[:, : self.KINDS] -= r
        dxy[:, : self.KINDS] *= scale
        dxy[:, self.KINDS :] *= grown
        dxy[row, self.KINDS + kind] -= grown[:, 0]
        out = np.zeros_like(self.vector)
        de, dwq, dwk, dwv, dwz, dwo, dg, dg0, du, du0 = self.parts(out)
        of_h, of_one = flat(h).T @ dxy, np.ones(len(dxy), np.float32) @ dxy
        dg[:], du[:] = of_h[:, : self.KINDS], of_h[:, self.KINDS :]
        dg0[:], du0[:] = of_one[: self.KINDS], of_one[self.KINDS :]
        made, dkv = np.zeros((*z.shape[:2], 4 * DIM), np.float32), np.empty((len(h), WINDOW, 2 * DIM), np.float32)
        dh = _times(dxy, np.concatenate([g, u], 1).T).reshape(h.shape)
        dh *= 1 - h * h
        dwo[:] = flat(o).T @ flat(dh)
        do = _times(dh, wo.T)
        do *= inverse
        ds = do @ v.transpose(0, 2, 1)
        ds -= _times(do * o, np.ones((DIM, 1), np.float32))
        ds *= s
        np.matmul(s.transpose(0, 2, 1), do, out=dkv[..., DIM:])
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :DIM])
        np.matmul(ds, k, out=made[1:, :, 2 * DIM : 3 * DIM])
        made[1:, :, 3 * DIM :] = dh
        made[1:, :, : 2 * DIM] = dkv[:, WINDOW - STEP :]
        made[:-1, :, : 2 * DIM] += dkv[:, : WINDOW - STEP]
        of_made = flat(z).T @ flat(made)
        for i, d in enumerate((dwk, dwv, dwq, dwz)):
            d[:] = of_made[:, i * DIM : (i + 1) * DIM]
        dwq *= SHRINK
        dz = _times(made, np.concatenate([wk, wv, wq * SHRINK, wz], 1).T)
        dz *= words.share[..., None]
        dz = flat(dz)
        de[:] = np.bincount((words.ids[:, None] * DIM + np.arange(DIM)).reshape(-1), dz[words.of].reshape(-1), BINS * DIM).reshape(BINS, DIM)
        de[END_OF_WORD % BINS] += words.closed.reshape(-1) @ dz
        return out


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product, not one for each window."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def _softmax(x: np.ndarray, *masks: np.ndarray) -> np.ndarray:
    """Of the last axis plus the masks, in place. The largest of each row is only taken off where a value is too far from 0 for
    exp; each row has a place without a mask."""
    far = x.size and max(x.max(), -x.min()) > FAR
    for mask in masks:
        x += mask
    if far:
        x -= x.max(2, keepdims=True)
    np.exp(x, x)
    x /= _times(x, np.ones((x.shape[-1], 1), np.float32))
    return x


def windows(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each token in its window, inside its row, scored there); places are tokens of the block."""
    n = np.diff(t.bounds)
    count = -(-n // STEP)
    row = np.repeat(np.arange(len(n)), count)
    j = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    place = (t.bounds[row] + j * STEP - (WINDOW - STEP))[:, None] + np.arange(WINDOW)
    valid = (place >= t.bounds[row][:, None]) & (place < t.bounds[row + 1][:, None])
    scored = valid & (np.arange(WINDOW) >= WINDOW - STEP)
    return place, valid, scored


class Places:
    """What the embedding of the words at some places takes, whose distinct words are given (-1: none): the number of each word's
    ids as a share, whether END_OF_WORD is its last, and of its other ids the bins of the first FEW and all of them in a row."""

    def __init__(self, t: Tokens, words: np.ndarray):
        self.words = words
        none = words < 0
        self.share, self.closed = np.where(none, np.float32(0), t.share[words]), np.where(none, np.float32(0), t.closed[words].astype(np.float32))
        self.size = np.where(none, 0, t.inner[words])
        flat = self.size.reshape(-1)
        self.ids = t.ids[_runs(t.at[words.reshape(-1)] * ~none.reshape(-1), flat)] % BINS
        self.of = np.repeat(np.arange(len(flat)), flat)
        self.first = np.append(0, np.cumsum(flat))
        some = np.append(self.ids, BINS)
        self.few = [some[np.where(self.size > j, self.first[:-1].reshape(words.shape) + j, len(self.ids))] for j in range(FEW)]

    def __getitem__(self, rows: slice) -> Places:
        """Those of some rows."""
        out, wide = object.__new__(Places), self.words.shape[1]
        a, z, _ = rows.indices(len(self.words))
        lo, hi = self.first[a * wide], self.first[z * wide]
        out.words, out.share, out.closed, out.size = self.words[rows], self.share[rows], self.closed[rows], self.size[rows]
        out.ids, out.of, out.first = self.ids[lo:hi], self.of[lo:hi] - a * wide, self.first[a * wide : z * wide + 1] - lo
        out.few = [x[rows] for x in self.few]
        return out


def places_of(t: Tokens, place: np.ndarray, valid: np.ndarray) -> Places:
    """(windows + 1, STEP): the words before the places of windows that follow each other, each place once."""
    opens = np.zeros(len(t.inverse) + 1, bool)
    opens[t.bounds[:-1]] = True
    place, valid = (np.concatenate([x[:1, :STEP], x[:, WINDOW - STEP :]]) for x in (place, valid))
    at = np.clip(place, 0, len(t.inverse) - 1)
    return Places(t, np.where(valid & ~opens[at], t.inverse[np.maximum(at - 1, 0)], -1))


def inputs(t: Tokens, place: np.ndarray, valid: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, Places]:
    """The embedding (x: of the distinct words) of the word before each place of windows that follow each other, each place once
    (zero at a text's start), and what is known of these places."""
    places = places_of(t, place, valid)
    out = x[places.words]
    out[places.words < 0] = 0
    return out, places


@dataclass
class LanguageModel:
    total: int
    distinct: int
    h: np.ndarray
    c: np.ndarray
    #: Log probabilities of ids by group, class of the id before, and id; the likeness of each id to each group; its band.
    table: np.ndarray
    likeness: np.ndarray
    band: np.ndarray
    #: The sum of base over the words of each class.
    mass: np.ndarray
    layer: Layer
    raw: bytes
    #: Of the words of h: class, logs of the probabilities by the groups, bounds of the ids of each, ids.
    kind: np.ndarray
    logs: np.ndarray
    at: np.ndarray
    ids: np.ndarray

    def counts(self, t: Tokens) -> np.ndarray:
        """Counts of the distinct words; -1 where the table has none."""
        out = np.full(len(t.hash), -1, np.int64)
        hit = t.known >= 0
        out[hit] = self.c[t.known[hit]]
        return out

    def all_counts(self, t: Tokens, rare: pa.StructArray) -> np.ndarray:
        """counts(t), with the rare words among them taken from rare: h, c."""
        known = self.counts(t)
        if len(rare):
            known[np.searchsorted(t.hash, rare.field("h").to_numpy().view(np.uint64))] = rare.field("c").to_numpy()
        return known

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def _of(self, t: Tokens, stored: np.ndarray, made: Callable[[Tokens], np.ndarray]) -> np.ndarray:
        """What the table has stored of its words, and what is made of the others' ids."""
        if t.known is None:
            return made(t)
        rest = np.flatnonzero(t.known < 0)
        out = stored[np.maximum(t.known, 0)] if len(self.h) else np.empty((len(t.hash), *stored.shape[1:]), stored.dtype)
        if len(rest):
            out[rest] = made(t.some(rest))
        return out

    def classes(self, t: Tokens) -> np.ndarray:
        """The class of each distinct word, by its ids."""
        return self._of(t, self.kind, lambda t: np.argmax(np.add.reduceat(self.likeness[t.ids], t.at[:-1]), 1) * BANDS + self.band[t.ids[t.at[:-1]]]).astype(np.int64)

    def experts(self, t: Tokens) -> np.ndarray:
        """The log probability of each distinct word by the ids' table of each group."""

        def made(t: Tokens) -> np.ndarray:
            cell = cells(t)
            return np.stack([np.add.reduceat(self.table[k][cell].astype(float), t.at[:-1]) for k in range(EXPERTS)], 1).astype(np.float32)

        return self._of(t, self.logs, made)


def groups_of(data: np.ndarray, bounds: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The group of each text: the nearest center of n-gram vectors."""
    return np.concatenate([np.argmax(v @ centers.T, 1) for v in _vectors(data, bounds)])


def _vectors(data: np.ndarray, bounds: np.ndarray, size: int = 200) -> Iterator[np.ndarray]:
    """The n-gram vectors of some texts after the other, so that short texts take no more memory than long ones."""
    for a in range(0, len(bounds) - 1, size):
        part = bounds[a : a + size + 1]
        yield langid.vectors(langid.counts(data[part[0] : part[-1]], part - part[0]), np.ones(langid.BINS, np.float32))


def _centers(learn: DataFrame, start: int = 600, rounds: int = 2) -> np.ndarray:
    """Groups of texts: spherical k-means over all learning texts, whose sums are made by the tasks. Only the places the
    centers start from are chosen among `start` texts."""
    spark = learn.sparkSession

    def vectors(batches):
        for b in batches:
            for _, _, data, bounds in C.blocks(b.column("text")):
                for v in _vectors(data, bounds):
                    yield pa.record_batch([pa.array([x.astype(np.float16).tobytes() for x in v], pa.binary())], ["x"])

    chosen = learn.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(start).withColumnRenamed("doc_id", "_chosen")
    got = learn.join(F.broadcast(chosen), F.col("doc_id") == F.col("_chosen"), "left_semi").select(C.byte_texts(learn)).mapInArrow(vectors, "x binary").orderBy("x").toArrow()
    x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in got.column("x")]).astype(np.float32)
    c = langid._kmeans(x, EXPERTS)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(c)

        def sums(batches, shared=shared):
            m = shared.value
            out = np.zeros(m.shape, np.int64)
            for b in batches:
                for _, _, data, bounds in C.blocks(b.column("text")):
                    for v in _vectors(data, bounds):
                        near = np.argmax(v @ m.T, 1)
                        v = np.rint(v * np.float32(1 << 20))  # whole numbers: their sum is the same in any order
                        for k in np.unique(near):
                            out[k] += v[near == k].sum(0, dtype=np.float64).astype(np.int64)
            hit = np.flatnonzero(out)
            yield pa.record_batch([pa.array(hit, pa.int32()), pa.array(out.reshape(-1)[hit])], ["cell", "n"])

        # At most EXPERTS * BINS rows, whatever the input.
        found = learn.select(C.byte_texts(learn)).mapInArrow(sums, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        fresh = np.zeros(c.size)
        fresh[found.column("cell").to_numpy()] = found.column("n").to_numpy()
        fresh = fresh.reshape(c.shape)
        length = np.sqrt((fresh * fresh).sum(1, keepdims=True))
        fresh = np.where(length > 0, fresh / np.maximum(length, 1), c).astype(np.float32)
        still = np.abs(fresh - c).max() < 1e-6
        c = fresh
        if still:
            break
    return np.concatenate([c, np.zeros((EXPERTS - len(c), c.shape[1]), np.float32)])


def word_counts(learn: DataFrame, centers: np.ndarray | None, raw: bytes) -> DataFrame:
    """h, ids, c, c0...: the tokens (hash, subword ids) of all learning texts, and of each group of them."""
    shared = learn.sparkSession.sparkContext.broadcast(centers)

    def rows(batches):
        for b in batches:
            for _, _, data, bounds in C.blocks(b.column("text")):
                w, h, at = hashes(data, bounds)
                near = np.repeat(groups_of(data, bounds, shared.value), np.diff(at))
                u, inverse = np.unique(h, return_inverse=True)
                where = np.full(len(u), -1, np.int64)
                where[inverse[np.arange(len(w.hash)) + w.row]] = np.arange(len(w.hash))
                n = np.bincount(inverse * EXPERTS + near, minlength=len(u) * EXPERTS).reshape(-1, EXPERTS)
                text = w.data.tobytes()
                words = [text[w.start[i] : w.end[i]] if i >= 0 else b"\n" for i in where.tolist()]
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(words, pa.binary()), *(pa.array(n[:, k].astype(np.int64)) for k in range(EXPERTS))], ["h", "w", *groups])

    groups = [f"c{i}" for i in range(EXPERTS)]
    found = learn.select(C.byte_texts(learn)).mapInArrow(rows, "h long, w binary, " + ", ".join(f"{g} long" for g in groups))
    each = found.groupBy("h", "w").agg(*(F.sum(g).alias(g) for g in groups))
    public = learn.sparkSession.sparkContext.broadcast(raw)

    def with_ids(batches):
        for b in batches:
            words = b.column("w").to_pylist()
            end = words.index(b"\n") if b"\n" in words else -1  # the end of a text; no word holds a line break
            if end >= 0:
                words[end] = b"."
            ids, size = _encoded(words, public.value)
            if end >= 0:
                at = int(size[:end].sum())
                ids, size[end] = np.concatenate([ids[:at], [END_OF_TEXT], ids[at + size[end] :]]), 1
            yield pa.record_batch([b.column("h"), C.lists(ids, np.append(0, np.cumsum(size)), pa.int32()), *(b.column(g) for g in groups)], ["h", "ids", *groups])

    each = each.mapInArrow(with_ids, "h long, ids array<int>, " + ", ".join(f"{g} long" for g in groups))
    return C.stored(each.withColumn("c", sum((F.col(g) for g in groups[1:]), F.col("c0"))), "counts")


def _vocabulary(b: pa.RecordBatch) -> Tokens:
    """The words of a batch of the counts as tokens."""
    h, ids = b.column("h").to_numpy().view(np.uint64), b.column("ids")
    return Tokens(h, np.arange(len(h)), np.array([0, len(h)]), ids.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(ids.value_lengths().to_numpy())).astype(np.int64))


def _experts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probabilities by group, class of the id before and id; likeness of ids to groups; bands of ids), of all words."""

    def rows(batches):
        out = np.zeros((EXPERTS, PREVIOUS * IDS), np.int64)
        for b in batches:
            t = _vocabulary(b)
            cell, size = cells(t), np.diff(t.at)
            for k in range(EXPERTS):
                n = b.column(f"c{k}").to_numpy()
                some = np.repeat(n > 0, size)
                np.add.at(out[k], cell[some], np.repeat(n, size)[some])
        hit = np.flatnonzero(out)
        yield pa.record_batch([pa.array(hit, pa.int32()), pa.array(out.ravel()[hit])], ["cell", "n"])

    # At most EXPERTS * PREVIOUS * IDS rows, whatever the input.
    sums = counts.drop("c").mapInArrow(rows, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(EXPERTS * PREVIOUS * IDS)
    n[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    n = n.reshape(EXPERTS, PREVIOUS, IDS)
    overall = n.sum((0, 1)) + 0.01
    share = (n.sum(1) + 0.5 * overall / overall.sum()) / (n.sum((1, 2))[:, None] + 0.5)
    first = n[:, 0].sum(0)
    order = np.argsort(-first, kind="stable")
    band = np.zeros(IDS, np.int64)
    band[order] = np.minimum((np.cumsum(first[order]) - first[order]) * BANDS / max(first.sum(), 1), BANDS - 1).astype(np.int64)
    overall /= overall.sum()
    return np.log((n + 5 * overall) / (n.sum(2, keepdims=True) + 5)).reshape(EXPERTS, -1).astype(np.float32), np.log(share).T.astype(np.float32), band


def _mass(counts: DataFrame, model: LanguageModel) -> np.ndarray:
    """The sum of base over the words of each class; an unseen word adds one share of its own."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        out = np.zeros((2, CLASSES), np.int64)
        for b in batches:
            of = shared.value.classes(_vocabulary(b))
            out[0] += np.bincount(of, minlength=CLASSES)
            out[1] += np.bincount(of, b.column("c").to_numpy(), CLASSES).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(CLASSES), pa.int32()), pa.array(out[0]), pa.array(out[1])], ["k", "v", "c"])

    found = counts.select("h", "ids", "c").mapInArrow(rows, "k int, v long, c long").groupBy("k").agg(F.sum("v").alias("v"), F.sum("c").alias("c")).toArrow()
    v, c = np.zeros(CLASSES), np.zeros(CLASSES)
    v[found.column("k").to_numpy()], c[found.column("k").to_numpy()] = found.column("v").to_numpy(), found.column("c").to_numpy()
    return model.base(c + 0.1 * v)


def _with_rare(texts: DataFrame, model: LanguageModel, counts: DataFrame, tasks: int) -> DataFrame:
    """text, rare: the counts of each text's words that the model's table lacks, joined by hash; null where it lacks none.
    Rows are dealt over tasks and sorted by a hash, so replicas learn alike wherever the counts lie."""
    dealt = texts.select(F.xxhash64("doc_id", "text").alias("_row"), "text")
    if len(model.h) == model.distinct:
        return dealt.repartition(tasks, "_row").withColumn("rare", F.lit(None).cast("array<struct<h:long,c:long>>")).sortWithinPartitions("_row").drop("_row")
    shared = texts.sparkSession.sparkContext.broadcast(model.h)

    def rows(batches):
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("text")):
                _, h, at = hashes(data, bounds)
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                u, inverse = np.unique(h, return_inverse=True)
                out = (shared.value[np.minimum(np.searchsorted(shared.value, u), len(shared.value) - 1)] != u if len(shared.value) else np.ones(len(u), bool))[inverse]
                u, of = C.distinct(h[out], row[out], hi - lo)
                yield pa.record_batch([pa.array(np.repeat(b.column("_row").to_numpy()[lo:hi], np.diff(of))), pa.array(u.view(np.int64))], ["_row", "h"])

    found = dealt.mapInArrow(rows, "_row long, h long").join(counts.select("h", "c"), "h").repartition(tasks, "_row")
    rare = found.groupBy("_row").agg(F.collect_set(F.struct("h", "c")).alias("rare"))
    return dealt.repartition(tasks, "_row").join(rare, "_row", "left").sortWithinPartitions("_row").drop("_row")


def _table(counts: DataFrame, model: LanguageModel) -> None:
    """Gives the model the words found at least as often as lets no more than TABLE words in, in the order of their hashes."""
    tally = counts.where("c >= 2").groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # a million rows at most
    order = np.argsort(-tally.column("c").to_numpy())
    c, n = tally.column("c").to_numpy()[order], np.cumsum(tally.column("n").to_numpy()[order])
    once = counts.where("c < 2").count()
    fits = c[n <= TABLE]
    least = 1 if (n[-1] if len(n) else 0) + once <= TABLE else int(fits.min()) if len(fits) else 1 << 62
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            t = _vocabulary(b)
            logs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * EXPERTS), len(t.hash), [None, pa.py_buffer(np.ascontiguousarray(shared.value.experts(t)))])
            yield pa.record_batch([b.column("h"), b.column("c"), pa.array(shared.value.classes(t).astype(np.int8)), logs.cast(pa.binary()), b.column("ids")], ["h", "c", "kind", "logs", "ids"])

    top = counts.where(F.col("c") >= least).select("h", "ids", "c").mapInArrow(rows, "h long, c long, kind byte, logs binary, ids array<int>").toArrow().combine_chunks()
    h, ids = top.column("h").to_numpy().view(np.uint64), top.column("ids").combine_chunks()
    order = np.argsort(h)
    size = ids.value_lengths().to_numpy().astype(np.int64)
    model.h, model.c, model.kind = h[order], top.column("c").to_numpy()[order], top.column("kind").to_numpy()[order]
    model.logs = np.frombuffer(b"".join(top.column("logs").to_pylist()), np.float32).reshape(-1, EXPERTS)[order]
    model.ids, model.at = ids.flatten().to_numpy()[_runs((np.cumsum(size) - size)[order], size[order])], np.append(0, np.cumsum(size[order]))


def fit(learn: DataFrame, every: int = 1, replicas: int = 64, rounds: int = 1, batch: int = BATCH, rate: float = 0.01, vocabulary: str = VOCABULARY) -> tuple[LanguageModel, DataFrame]:
    """(model, table of word counts). learn: doc_id, text of the texts that may teach."""
    spark = learn.sparkSession
    some = not learn.isEmpty()
    with open(vocabulary, "rb") as f:
        raw = f.read()
    counts = word_counts(learn, _centers(learn) if some else None, raw)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    none = np.zeros(0, np.int64)
    model = LanguageModel(total, distinct, none.view(np.uint64), none, *_experts(counts), np.ones(CLASSES), Layer(), raw, none, np.zeros((0, EXPERTS), np.float32), np.zeros(1, np.int64), none)
    model.mass = _mass(counts, model)
    model.layer.vector[-CLASSES:] = np.log(np.maximum(model.mass, model.base(0)))  # the classes' shares, before anything is learned
    _table(counts, model)
    if not total:
        return model, counts
    part = _with_rare(learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("doc_id", C.byte_texts(learn)), model, counts, int(min(replicas, 1 + total // REPLICA)))
    part = part.persist(StorageLevel.DISK_ONLY) if rounds > 1 else part
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def train(batches, shared=shared, number=number):
            m = shared.value
            layer = Layer(m.layer.vector.copy())
            mean, square = np.zeros_like(layer.vector), np.zeros_like(layer.vector)
            step = seen = 0
            for b in batches:
                for lo, hi, data, bounds in C.blocks(b.column("text"), 400_000):
                    t = tokens(data, bounds, m.raw, m)
                    place, valid, scored = windows(t)
                    known = m.all_counts(t, b.column("rare").slice(lo, hi - lo).flatten())  # each word without its own occurrence, as in unseen text
                    base, kind = m.base(np.maximum(known, 1) - 1), m.classes(t)
                    p = np.concatenate([base[:, None], (base / (m.mass + m.base(0))[kind])[:, None], np.exp(m.experts(t).astype(float))], 1)
                    p = (p / p.max(1, keepdims=True)).astype(np.float32)  # only their ratios count
                    places = places_of(t, place, valid)
                    word, here = t.inverse[np.clip(place[:, WINDOW - STEP :], 0, len(t.inverse) - 1)], scored[:, WINDOW - STEP :]
                    for i in range(0, len(place), batch):
                        some = slice(i, i + batch)
                        before = places[i : i + batch + 1]
                        grad = layer.gradient(layer.embedded(before), valid[some], here[some], p[word[some]], kind[word[some]], before, t)
                        step += 1
                        mean *= np.float32(0.9)
                        mean += np.float32(0.1) * grad
                        square *= np.float32(0.99)
                        grad *= grad
                        grad *= np.float32(0.01)
                        square += grad
                        root = np.sqrt(square)
                        root *= np.float32((1 - 0.99**step) ** -0.5)
                        root += np.float32(1e-6)
                        np.divide(mean, root, out=root)
                        root *= np.float32(rate / (1 + 2 * number) / (1 - 0.9**step))
                        layer.vector -= root
                    seen += len(t.inverse)
            if seen:
                yield pa.record_batch([pa.array([seen]), pa.array([layer.vector.astype(np.float32).tobytes()], pa.binary())], ["n", "v"])

        done = part.mapInArrow(train, "n long, v binary").toArrow()  # one vector for each replica
        got = sorted(zip(done.column("n").to_pylist(), done.column("v").to_pylist(), strict=True))
        if got:
            model.layer = Layer(np.average([np.frombuffer(v, np.float32) for _, v in got], axis=0, weights=[n for n, _ in got]))
        shared.destroy()
    if rounds > 1:
        part.unpersist()
    return model, counts


def apply(docs: DataFrame, model: LanguageModel, counts: DataFrame, attend: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row; attend=False leaves the attention out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE words at most, and tables of fixed size
    norm = model.total + 0.1 * (model.distinct + 1)

    def rows(batches):
        m, number = shared.value, TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("text"), 400_000):
                t = tokens(data, bounds, m.raw, m)
                place, valid, scored = windows(t)
                known, experts, x, kind = m.counts(t), np.exp(m.experts(t).astype(float)), m.layer.embed(t), m.classes(t)
                n = len(t.inverse)
                first, rest = np.empty(n), np.empty(n)  # p(word) = first * base + rest
                mass = (m.mass + m.base(0))[kind]
                before = places_of(t, place, valid).words
                x = np.concatenate([x, np.zeros((1, DIM), np.float32)])  # the last one where there is no word
                for a in range(0, len(place), 128):
                    some = slice(a, a + 128)
                    w, y, _ = m.layer.forward(x[before[a : a + 129]], valid[some], attend)
                    mine = np.flatnonzero(scored[some][:, WINDOW - STEP :])
                    at = place[some][:, WINDOW - STEP :].reshape(-1)[mine]
                    w, word = w.reshape(-1, Layer.KINDS)[mine].astype(float), t.inverse[at]
                    first[at] = w[:, 0] + w[:, 1] * y.reshape(-1, CLASSES)[mine, kind[word]] / mass[word]
                    rest[at] = np.einsum("ij,ij->i", w[:, 2:], experts[word])
                common = known[t.inverse] >= 0
                p = m.base(np.maximum(known[t.inverse], 0))
                row = np.repeat(np.arange(hi - lo), np.diff(t.bounds))
                base, score = np.where(common, np.log10(p), 0), np.where(common, np.log10(first * p + rest), 0)
                rare = np.flatnonzero(~common)
                at = np.searchsorted(row[rare], np.arange(hi - lo + 1))
                n = hi - lo
                yield pa.record_batch(
                    [pa.array(number + np.arange(n)), b.column("doc_id").slice(lo, n), pa.array(np.diff(t.bounds)), pa.array(np.bincount(row, common, n).astype(np.int64)), pa.array(np.bincount(row, base, n)), pa.array(np.bincount(row, score, n)), C.lists(t.hash[t.inverse[rare]].view(np.int64), at, pa.int64()), C.lists(first[rare].astype(np.float32), at, pa.float32()), C.lists(np.log10(rest[rare] + 1e-300).astype(np.float32), at, pa.float32())],
                    ["row", "doc_id", "n_tokens", "known", "base", "score", "h", "first", "rest"],
                )
                number += n

    done = C.stored(docs.select(F.col("doc_id").cast("long"), C.byte_texts(docs)).mapInArrow(rows, "row long, doc_id long, n_tokens long, known long, base double, score double, h array<long>, first array<float>, rest array<float>"), "scored")
    rare = done.select("row", F.explode(F.arrays_zip("h", "first", "rest")).alias("x")).select("row", "x.*")
    p = (F.coalesce("c", F.lit(0)) + 0.1) / norm
    late = rare.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(F.count("c").alias("k"), F.sum(F.log10(p)).alias("b"), F.sum(F.log10(F.col("first") * p + F.pow(F.lit(10.0), F.col("rest").cast("double")))).alias("s"))
    zero = F.lit(0)
    return done.select("row", "doc_id", "n_tokens", "known", "base", "score").join(late, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("k", zero)).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score")
    )
