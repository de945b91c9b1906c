"""Structured Streaming: facts of files as they arrive, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.operators.cache import FactCache


def stream_files(spark: SparkSession, path: str, glob: str = "*.{ts,tsx}") -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.lit("disk").alias("version"), F.decode("content", "UTF-8").alias("content"))


def refresh(files: DataFrame, cache: FactCache, tool: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Every new file goes through the cache once; a restarted query goes on where it was."""

    def each(batch: DataFrame, _: int) -> None:
        cache.observe(batch, tool, extract)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kind_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by kind and event-time window; rows later than ``late`` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("event_type").alias("kind"), "n")
