"""Tables that change as a whole: written aside first, then shown by one line of a manifest.

A base folder holds the parts of its tables and a manifest, each line of which names the parts of all tables at one version.
A run writes its parts, counts them, and appends its line last, by one small write that Spark commits at once: a run that fails
before leaves readers with the version before it, and several tables change together. Null values are kept as they are.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST = "version bigint, id string, tables map<string, array<string>>, rows map<string, bigint>"


def versions(spark: SparkSession, base: str) -> DataFrame:
    """The lines of the manifest; none where there is no manifest yet."""
    try:
        return spark.read.schema(MANIFEST).json(f"{base}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _last(spark: SparkSession, base: str) -> dict[str, list[str]]:
    row = versions(spark, base).orderBy(F.desc("version"), F.desc("id")).limit(1).collect()  # one line
    return dict(row[0]["tables"]) if row else {}


def current(spark: SparkSession, base: str, table: str) -> DataFrame:
    """A table as the last whole version has it."""
    parts = _last(spark, base).get(table)
    if not parts:
        raise ValueError(f"no version of {base} has a table {table}")
    return spark.read.parquet(*(f"{base}/{p}" for p in parts))


def _changed(spark: SparkSession, base: str, new: dict[str, DataFrame], keep_parts: bool) -> None:
    tables, rows = _last(spark, base), {}
    for name, df in new.items():
        part = f"parts/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{base}/{part}")
        rows[name] = spark.read.schema(df.schema).parquet(f"{base}/{part}").count()
        tables[name] = [*(tables.get(name, []) if keep_parts else []), part]
    spark.createDataFrame([(time.time_ns(), uuid.uuid4().hex, tables, rows)], MANIFEST).coalesce(1).write.mode("append").json(f"{base}/manifest")


def refreshed(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> None:
    """Puts new tables in the place of those of the same names, all at one moment; other tables stay. A table may be made from its
    own version before. Of two runs at once the one that ends last is shown."""
    _changed(spark, base, tables, False)


def appended(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> None:
    """Adds rows to tables (new ones begin with them), all at one moment, without a rewrite of what is there."""
    _changed(spark, base, tables, True)


def unused(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Parts that none of the last `keep` versions names: they may be deleted once no reader uses an older version."""
    lines = [set(p for ps in r["tables"].values() for p in ps) for r in versions(spark, base).orderBy("version", "id").collect()]  # one a run
    used = set().union(*lines[-keep:]) if lines else set()
    return sorted(set().union(*lines) - used) if lines else []
