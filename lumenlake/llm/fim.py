"""Fill-in-middle transformation: texts cut at two units and put together in another order.

Counting a text's units leaves a sparse index: the byte and code-point offset of each `every`-th unit. A cut is found by binary
search among these and a short rescan from there, so no table of all units is kept. Units are code points ('char'), words with
the white space that follows ('word'; white space before the first word is a unit of its own), or lines with their end ('line').

A null or empty text has no unit and stays plain. A null key is read as an empty one. Rows that repeat are cut alike; an empty
table gives no rows. Of the input only the key and the text are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C

# The marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
EVERY = 1024
#: Bytes that are counted at a time, whatever the length of a text.
COUNTED = 1 << 18
_SPACE = C._table(C.ASCII_SPACE)


def _begins(data: np.ndarray, lo: int, hi: int, unit: str) -> np.ndarray:
    """Which of data[lo:hi] begin a unit; the first byte of a text does as well."""
    part = data[lo:hi]
    if unit == "char":
        return (part & 0xC0) != 0x80
    before = data[lo - 1 : hi - 1] if lo else np.concatenate([[np.uint8(10)], part[:-1]])
    return (before == 10) if unit == "line" else ~_SPACE[part] & _SPACE[before]


@dataclass
class Index:
    """Of each text: its units and code points; and for every so many units the unit's number, byte and code point. Those of
    text r stand at bounds[r] to bounds[r + 1]."""

    unit: str
    units: np.ndarray
    chars: np.ndarray
    bounds: np.ndarray
    number: np.ndarray
    byte: np.ndarray
    char: np.ndarray

    def cut(self, data: np.ndarray, first: int, last: int, r: int, k: int) -> tuple[int, int]:
        """(byte, code point) at which unit k of text r begins; the text's end for k beyond its last. first, last: its bytes."""
        if k >= self.units[r]:
            return last, int(self.chars[r])
        lo, hi = self.bounds[r], self.bounds[r + 1]
        at = lo + int(np.searchsorted(self.number[lo:hi], k, "right")) - 1
        byte, left = int(self.byte[at]), k - int(self.number[at])
        if not left:
            return byte, int(self.char[at])
        stop = int(self.byte[at + 1]) if at + 1 < hi else last
        here = _begins(data, byte, stop, self.unit)
        here[0] = True
        off = int(np.flatnonzero(here)[left])
        return byte + off, int(self.char[at]) + int(((data[byte : byte + off] & 0xC0) != 0x80).sum())


def index(data: np.ndarray, bounds: np.ndarray, unit: str = "char", every: int = EVERY) -> Index:
    """The index of texts that lie one after the other in data, made in one pass over pieces of fixed size."""
    if unit not in ("char", "word", "line"):
        raise ValueError("unit is char, word or line")
    n = len(bounds) - 1
    filled = np.flatnonzero(np.diff(bounds))
    heads = bounds[:-1][filled]
    units, chars = np.zeros(n, np.int64), np.zeros(n, np.int64)
    units0, chars0 = np.zeros(n, np.int64), np.zeros(n, np.int64)  # counted before a text
    row, number, byte, char = [], [], [], []
    u = c = 0
    for lo in range(0, len(data), COUNTED):
        hi = min(lo + COUNTED, len(data))
        lead = (data[lo:hi] & 0xC0) != 0x80
        a, z = np.searchsorted(heads, [lo, hi])
        if unit == "char":
            begin = lead
        else:
            begin = _begins(data, lo, hi, unit)
            begin[heads[a:z] - lo] = True
        p = np.flatnonzero(begin) + lo
        seen = np.cumsum(lead, dtype=np.int32)
        at_char = c + seen[p - lo] - 1
        of = np.searchsorted(heads, p, "right") - 1
        new = np.searchsorted(p, heads[a:z])
        units0[filled[a:z]], chars0[filled[a:z]] = u + new, at_char[new]
        r = filled[of]
        rank = u + np.arange(len(p)) - units0[r]
        keep = rank % every == 0
        row.append(r[keep])
        number.append(rank[keep])
        byte.append(p[keep])
        char.append(at_char[keep] - chars0[r[keep]])
        u, c = u + len(p), c + (int(seen[-1]) if len(seen) else 0)
    ends = np.append(units0[filled[1:]], u), np.append(chars0[filled[1:]], c)
    units[filled], chars[filled] = ends[0] - units0[filled], ends[1] - chars0[filled]
    none = np.zeros(0, np.int64)
    rows = np.concatenate([*row, none])
    return Index(unit, units, chars, np.searchsorted(rows, np.arange(n + 1)), *(np.concatenate([*x, none]) for x in (number, byte, char)))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", every: int = EVERY, seed: str = "1:", plain: int = 90, spm: int = 20) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars (code points), output of each row; one pass without a shuffle.

    The first four 8-digit groups h1 to h4 of the hex sha256 of seed and key decide: prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, middle after the larger. A text that is empty or holds a mark, or with h3 % 100 >= plain,
    stays plain and has null lengths; h4 % 100 < spm puts the suffix first. A text itself is never changed, so output and form
    give it back (restored)."""
    if key.lower() in ("n", "form", "prefix_chars", "middle_chars", "output"):
        raise ValueError("the key's name is that of a result column")
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    p, s, m = marks

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("_text")):
                ix = index(data, bounds, unit, every)
                form, before, inner, out = [], [], [], []
                for r, name in enumerate(b.column("_name").slice(lo, hi - lo).to_pylist()):
                    first, last, n = int(bounds[r]), int(bounds[r + 1]), int(ix.units[r])
                    whole = data[first:last].tobytes()
                    digest = hashlib.sha256(f"{seed}{name or ''}".encode()).hexdigest()
                    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
                    if not n or h3 % 100 >= plain or any(x in whole for x in marks):
                        form.append("plain")
                        before.append(None)
                        inner.append(None)
                        out.append(whole)
                        continue
                    (i, ci), (j, cj) = (ix.cut(data, first, last, r, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    i, j = i - first, j - first
                    back = h4 % 100 < spm
                    form.append("spm" if back else "psm")
                    before.append(ci)
                    inner.append(cj - ci)
                    out.append(b"".join((s, whole[j:], p, whole[:i], m, whole[i:j]) if back else (p, whole[:i], s, whole[j:], m, whole[i:j])))
                cols = [b.column(key).slice(lo, hi - lo), pa.array(ix.units), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inner, pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    read = docs.select(docs[key].alias(key), docs[key].cast("string").alias("_name"), docs[text].cast("string").cast("binary").alias("_text"))
    kind = read.schema[key].dataType.simpleString()
    done = read.mapInArrow(rows, f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return done.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that transform read, from its output and form alone. The marks stand once each, for a text with one is plain."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


ORACLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (n + 1) AS b, CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 AS h4 FROM d),
c AS (SELECT doc_id, n, t, CAST(least(a, b) AS BIGINT) AS i, CAST(greatest(a, b) AS BIGINT) AS j, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, i) AS x, substring(t, i + 1, j - i) AS y, substring(t, j + 1, n - j) AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
