"""Streaming ingestion of records: validation and deduplication within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.records import sequence_hash, sequence_reason


def validated(stream: DataFrame, sequence: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Valid records of a stream, each sequence once within ``delay`` of event time."""
    keyed = stream.withColumn("reason", sequence_reason(F.col(sequence))).withColumn("sequence_sha256", sequence_hash(F.col(sequence)))
    return keyed.filter(F.col("reason").isNull()).withWatermark(at, delay).dropDuplicatesWithinWatermark(["sequence_sha256"])


def windowed_counts(stream: DataFrame, key: str, at: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts of each key in windows of event time."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("window"), key).agg(F.count("*").alias("n"))
