"""Registered queries over the full-text and trigram indexes, each beside its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.operators import postings, trigrams
from lumenlake.operators.registry import QUERIES, _query, _t

_ASK = 'the "of the" -der OR src3 de OR widget'
_WEIGHTS = {"documents": 1.0, "turns": 0.9, "parts": 0.5}
_WORDS = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
_COUNTS = lambda w: f"list_concat(list_transform(list_filter(a, lambda x: x = '{w}'), lambda x: 1.0::DOUBLE), list_transform(list_filter(c, lambda x: x = '{w}'), lambda x: 0.2::DOUBLE))"
_HAS = lambda w: f"list_contains(b, '{w}')"


def _weighs(w):
    v, top = _COUNTS(w), f"list_max({_COUNTS(w)})"
    return f"CASE WHEN len({v}) = 0 THEN 0 ELSE ({top} + list_sum(list_transform({v}, lambda x, i: x / (i * i))) - {top} / power(list_position({v}, {top}), 2)) / 1.64493406685 END"


def _texts(spark, sf):
    row = lambda df, source, key, moment, german, *fields: df.select(F.lit(source).alias("source"), F.col(key).alias("key"), moment.alias("moment"), german.alias("german"), F.array(*fields).alias("fields"))
    f, none, no = postings.field, F.lit(None), F.lit(False)
    docs = row(_t(spark, sf, "documents"), "documents", "doc_id", none, no, f("A", F.col("text")), f("C", F.concat_ws(" ", "lang", "source")))
    turns = row(_t(spark, sf, "conversations"), "turns", "conv_id", F.col("turn"), no, f("A", F.col("text")))
    return docs.unionByName(turns).unionByName(row(_t(spark, sf, "part"), "parts", "p_partkey", none, no, f("A", F.col("p_name"))))


@_query(f"""WITH s AS (SELECT 1.0 AS weight, doc_id AS key, NULL::DOUBLE AS moment, {_WORDS('text')} AS a, {_WORDS("concat_ws(' ', lang, source)")} AS c FROM documents
UNION ALL SELECT 0.9, conv_id, turn, {_WORDS('text')}, [] FROM conversations UNION ALL SELECT 0.5, p_partkey, NULL, {_WORDS('p_name')}, [] FROM part),
t AS (SELECT weight, key, moment, coalesce(a, []) AS a, coalesce(c, []) AS c, list_concat(coalesce(a, []), coalesce(c, [])) AS b FROM s),
h AS (SELECT key, moment, round(weight * ({' + '.join(map(_weighs, ['the', 'of', 'src3', 'de', 'widget']))}) / 5 / (1 + ln(greatest(len(b), 1))), 6) AS score FROM t
WHERE ({_HAS('the')} AND NOT {_HAS('der')} AND len(list_filter(list_zip(b, b[2:]), lambda z: z[1] = 'of' AND z[2] = 'the')) > 0) OR ({_HAS('src3')} AND {_HAS('de')}) OR {_HAS('widget')})
SELECT key, moment, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, moment NULLS LAST) = 1) ORDER BY score DESC, key LIMIT 200""")
def words_indexed(spark, sf):
    return postings.search(postings.build(_texts(spark, sf)), _ASK, _WEIGHTS, by_length=True)


def german_words(spark, sf):
    """Documents as analyses, stemmed where they are German; conversations as speech, their turns as segments."""
    d = _t(spark, sf, "documents")
    docs = d.select(F.lit("analyses").alias("source"), F.col("doc_id").alias("key"), F.lit(None).cast("double").alias("moment"), (F.col("lang") == "de").alias("german"), F.array(postings.field("A", F.col("text"))).alias("fields"))
    part = F.array_sort(F.collect_list(F.struct("turn", "text")))  # the turns of a conversation
    talks = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(part, lambda x: postings.field("A", x["text"], x["turn"])).alias("fields"))
    talks = talks.select(F.lit("speech").alias("source"), F.col("conv_id").alias("key"), F.lit(None).cast("double").alias("moment"), F.lit(True).alias("german"), "fields")
    return postings.search(postings.build(docs.unionByName(talks)), "heiten OR erten -the", {"analyses": 1.0, "speech": 0.9})


_Q = "red wiget"
_ORDERED = lambda x: f"flatten(list_transform({_WORDS(x)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"
_QG = f"list_distinct({_ORDERED(chr(39) + _Q + chr(39))})"
_COMMON = "len(list_intersect(q, list_distinct(g[i:j])))"


@_query(f"""WITH n AS (SELECT p_partkey AS key, {_QG} AS q, {_ORDERED('name')} AS g FROM (SELECT p_partkey, unnest([p_name, p_type]) AS name FROM part)),
h AS (SELECT *, list_filter(range(1, len(g) + 1), lambda i: list_contains(q, g[i])) AS hits FROM n),
l AS (SELECT key, round(coalesce(list_max(flatten(list_transform(hits, lambda i: list_transform(list_filter(hits, lambda j: j >= i), lambda j: {_COMMON} / (len(q) + len(list_distinct(g[i:j])) - {_COMMON}))))), 0), 6) AS likeness FROM h)
SELECT key, max(likeness) AS likeness FROM l WHERE likeness >= 0.5 GROUP BY 1 ORDER BY likeness DESC, key LIMIT 200""")
def names_indexed(spark, sf):
    return trigrams.alike(trigrams.build(_t(spark, sf, "part"), "p_partkey", ["p_name", "p_type"]), _Q)


# Stems have no SQL: tests/test_postings.py holds them against plain Python.
QUERIES["german_words"] = german_words
