"""The stages of corpus_pipeline: each takes (spark, docs, sf_dir) and calls one operator on all rows it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import common as C
from lumenlake.llm import decontam, jaccard, lines, pieces, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of a half or more go; null and empty texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = C.fresh("_score", docs)
    scored = toxicity.apply(docs, model, docs.columns, score)
    return scored.where((F.col(score) < 0.5) | F.coalesce(F.length("text") == 0, F.lit(True))).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first one only, whole equal lines of over 50 words that two documents
    share too (not passages broken over lines, wrapped otherwise or inside a longer line); a document that loses all its words goes, one that had none stays. n_chars follows the text."""
    names = kept, _, dropped = [C.fresh(n, docs) for n in ("_kept", "_n_lines", "_n_dropped")]
    done = lines.dedup_text(docs, min_docs=10, keep_first=True, long_words=50, long_docs=2, names=names)
    left = done.where((F.col(dropped) == 0) | (F.length(F.trim(F.col(kept), F.lit(lines.SPACE))) > 0))
    changed = F.col(dropped) > 0
    values = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*(values[c].alias(c) if values.get(c) is not None else F.col(f"`{c}`") for c in docs.columns))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; rows that repeat it go. Rows that share a
    doc_id and are not alike are documents of their own."""
    mark = C.fresh("_gone", docs)
    found = jaccard.near_components(docs, k=5, percent=80, by_set=True).where("component_id is not null")
    gone = F.col("doc_id") != F.col("component_id")
    some = C.stored(found.groupBy("doc_id").agg(F.bool_and(gone).alias("all"), F.bool_or(gone).alias("any")).where("any"), "gone")
    lost = lambda rows, name: rows.select(F.col("doc_id").alias(name))
    left = docs.join(lost(some, mark), docs["doc_id"].cast("long") == F.col(mark), "left_anti")
    mixed = some.where("not all")
    if not mixed.isEmpty():  # doc_ids of which some texts stay: these are told apart by their sets
        text = C.fresh("_set", docs)
        shared = docs.join(lost(mixed, mark), docs["doc_id"].cast("long") == F.col(mark), "left_semi")
        shared = jaccard.set_hashes(shared, 5, text)
        sets = found.where(gone).select(F.col("doc_id").alias(mark), F.col("set_hash").alias(f"{mark}_set")).distinct()
        kept = shared.join(sets, (shared["doc_id"].cast("long") == F.col(mark)) & (F.col(text) == F.col(f"{mark}_set")), "left_anti")
        left = left.unionByName(kept.select(*docs.columns))
    return C.stored(left, "near").dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of a benchmark item's shingles go; another text under their doc_id stays."""
    mark = C.fresh("_hit", docs)
    hit = decontam.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True).select(F.col("doc_id").alias(mark), F.col("text_hash").alias(f"{mark}_text")).distinct()
    return docs.join(hit, (docs["doc_id"].cast("long") == F.col(mark)) & (F.xxhash64(docs["text"]) == F.col(f"{mark}_text")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document left: its piece ids' number and digest, and whether they decode to the text exactly."""
    return pieces.roundtrip(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_near), ("decontamination", drop_leaks), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
