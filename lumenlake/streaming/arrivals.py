"""Arrivals as a stream: each event once, however often it is delivered."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once(arrivals: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Streaming rows without repeats of a key within `late`; the watermark bounds the state."""
    return arrivals.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def taken_in(spark: SparkSession, folder: str, name: str, key: str, time: str, late: str) -> DataFrame:
    """All files `name` of a folder that have come so far, streamed through `once` to a table in the shared folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    at = at or tempfile.mkdtemp(prefix="lumenlake-")
    base = f"{at}/arrivals-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    run = once(stream, key, time, late).writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/rows")
