"""Line deduplication with DataFrame functions only.

Hashes of line keys are range-partitioned by (key, document) and sorted by key, document and position. One pass over that
order marks the first line of each key in each document: a window over the same columns asks for no other shuffle or sort. A key
whose documents lie in several ranges (a hot key does) is joined by its ends: each range hands on one row a key, with the number
of its documents and its first line. What comes back for a document is a compressed bitmap of the lines it loses (64-bit words,
those without a loss left out), not text.

Defined cases: null and empty text are one empty line; blank lines are never dropped; rows with one doc_id count as one
document and null doc_id as one more; repeated rows get the same answer each; extra columns pass through `dedup_text`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased; text of one byte a character takes the fast way."""
    line = F.trim(line, F.lit(SPACE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _row_key(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(_text(docs)).alias("_text_hash")]


def marked(hashed: DataFrame, parts: int) -> DataFrame:
    """hashed (h, h2, _doc, pos, ...) in the order of key, document and position, with once: whether a line is the first of its
    key in its document. Of rows with one doc_id and equal positions one is the first."""
    order = W.partitionBy("h", "h2", "_doc").orderBy("pos")
    return hashed.repartitionByRange(parts, "h", "h2", "_doc").sortWithinPartitions("h", "h2", "_doc", "pos").withColumn("once", F.row_number().over(order) == 1)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, long_words: int | None = None, long_docs: int = 2) -> DataFrame:
    """_doc, _text_hash, lost: array of (word, bits) for the documents that lose a line. A line goes if its key is found in
    at least min_docs documents (long_docs, if it has more than long_words words); with keep_first, the key's first line by
    (doc_id, position) stays."""
    exploded = docs.select(*_row_key(docs), F.posexplode(F.split(_text(docs), "\n")).alias("pos", "line"))
    keyed = exploded.select("_doc", "_text_hash", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") > 0)
    long = F.size(F.regexp_extract_all("k", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))) > long_words if long_words else F.lit(False)
    hashed = keyed.select(F.xxhash64("k").alias("h"), F.xxhash64(F.lit(7), "k").alias("h2"), "_doc", "_text_hash", "pos", long.alias("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = C.stored(marked(hashed, parts), "lines")
    # Of each range one row a key is shuffled, not one for each document.
    keys = lines.where("once").groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_doc", "pos")).alias("first"), F.first("long").alias("long"))
    keys = keys.where((F.col("n") >= min_docs) | (F.col("long") & (F.col("n") >= long_docs))).drop("long")
    hit = lines.join(keys, ["h", "h2"])
    if keep_first:
        hit = hit.where(~(F.col("_doc").eqNullSafe(F.col("first._doc")) & (F.col("pos") == F.col("first.pos"))))
    word = hit.select("_doc", "_text_hash", (F.col("pos") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit")).groupBy("_doc", "_text_hash", "word").agg(F.bit_or("bit").alias("bits"))
    return word.groupBy("_doc", "_text_hash").agg(F.collect_list(F.struct("word", "bits")).alias("lost"))


def dedup_text(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, long_words: int | None = None, long_docs: int = 2, names: Sequence[str] = ("_kept", "_n_lines", "_n_dropped")) -> DataFrame:
    """docs with the text without its lost lines, its number of lines and of lost ones, under `names`, which no column of docs may
    have. Other columns of docs may be called anything."""
    bitmaps = keep_bitmaps(docs, min_docs, keep_first, long_words, long_docs)
    left = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)), docs["text"].alias("text"), *_row_key(docs))
    on = left["_doc"].eqNullSafe(bitmaps["_doc"]) & (left["_text_hash"] == bitmaps["_text_hash"])
    joined = left.join(bitmaps.withColumnRenamed("lost", "_lost"), on, "left").drop("_doc", "_text_hash")
    text = F.coalesce(joined["text"].cast("string"), F.lit(""))
    lost = F.map_from_entries("_lost")
    kept = F.expr(
        "array_join(filter(_lines, (x, i) -> (coalesce(element_at(_bits, cast(i / 64 as int)), 0L) & shiftleft(1L, i % 64)) = 0), '\\n')"
    )
    out = joined.select("*", F.when(F.col("_lost").isNotNull(), F.split(text, "\n")).alias("_lines"), lost.alias("_bits"))
    dropped = F.aggregate("_lost", F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x["bits"]))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return out.select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)),
        F.when(F.col("_lost").isNull(), text).otherwise(kept).alias(names[0]),
        n_lines.cast("long").alias(names[1]),
        F.coalesce(dropped, F.lit(0).cast("long")).alias(names[2]),
    )


def line_dedup(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text for each row."""
    slim = docs.select("doc_id", "text")
    return dedup_text(slim, min_docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) > 0 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""
