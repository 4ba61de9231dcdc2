"""The registered queries of the numbered operators: each runs over its whole tables and returns its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import common as C
from lumenlake.llm import decontam, divergence, fim, html, jaccard, langid, lines, lm, pieces, quality, shards, toxicity, urls


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    model, counts = lm.fit(docs.where(C.fold(F.col("doc_id"), 10) != 0).select(F.col("doc_id").cast("long"), "text"))
    scored = lm.apply(docs, model, counts)
    return scored.select("doc_id", (C.fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.materialise(_read(spark, sf, "documents"), stored=False)[0]


def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.roundtrip(_read(spark, sf, "documents"))


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contained(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_components(_read(spark, sf, "documents"), k=4, percent=85)


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    model = langid.fit(docs.where(C.fold(F.col("doc_id"), 4) != 2))
    return langid.apply(docs, model).select("doc_id", (C.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_dedup(_read(spark, sf, "documents"), min_docs=10)


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    model = toxicity.fit(docs.where(C.fold(F.col("doc_id"), 5) != 0), _read(spark, sf, "labels"))
    return toxicity.apply(docs, model).select("doc_id", (C.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(_read(spark, sf, "pages"))


#: The rules of op11, fixed by its contract.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op11_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(_read(spark, sf, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fim.transform(_read(spark, sf, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(_read(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_token_shards, op3_sentencepiece, op4_quality_rules, op5_benchmark_decontamination, op6_ngram_jaccard_join, op7_language_id, op8_line_dedup, op9_toxicity, op10_html_extraction, op11_url_filters, op12_fill_in_middle, op13_source_divergence)}
ORACLES: dict[str, str] = {"op8_line_dedup": lines.ORACLE, "op11_url_filters": urls.oracle(URL_RULES), "op12_fill_in_middle": fim.ORACLE, "op13_source_divergence": divergence.ORACLE}
