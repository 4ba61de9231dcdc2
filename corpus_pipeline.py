"""A training-corpus pipeline of five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlake.llm import pipeline as P

STAGES = P.STAGES
#: Learned models and components cannot be told in SQL: its stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    return P.run(spark, sf_dir)
