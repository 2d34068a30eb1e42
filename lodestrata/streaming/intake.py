"""Streaming faces of batch operators, an extension: intake without repeats, hourly counts, replacement per key in micro-batches.

Results and progress go to a new folder under the shared folder that the session names for checkpoints.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import shared_folder
from lodestrata.sources.sinks import replace_partitions


def stream_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def files(spark: SparkSession, path: str, schema_of: DataFrame | None = None) -> DataFrame:
    """A stream of the parquet files at a path, whether it names a folder or one file."""
    schema = (schema_of or spark.read.parquet(path)).schema
    folder, name = os.path.split(path.rstrip("/"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path) if not _single(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _single(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


def without_repeats(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of every key; keys are kept no longer than `delay` behind the greatest time seen, and rows that come later than that are
    lost. Rows without a time pass once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def hourly_counts(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """hour, event_type, events, total of everything at the path now, as a stream that ends with it."""
    stream = files(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))
    events = without_repeats(stream, ["event_id"], "ts", delay)
    folder = stream_folder(spark)
    events.select("event_id", "ts", "event_type", "value").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{folder}/rows")
    return kept.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


def replace_per_key(stream: DataFrame, path: str, key: str, progress: str):
    """A running query that rewrites, in every micro-batch, the partitions of the keys it holds."""
    return stream.writeStream.foreachBatch(lambda batch, _: replace_partitions(batch, path, key)).option("checkpointLocation", progress).trigger(availableNow=True).start()
