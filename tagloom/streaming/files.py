"""Markup files as they arrive: Structured Streaming over new documents, with the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_documents(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """One row per new file: filename and document. All functions of ``tagloom.functions`` apply."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.input_file_name().alias("filename"), F.col("value").alias("document"))


def windowed_counts(events: DataFrame, at: str, by: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key of a stream (or table) of extracted rows, with late rows allowed for ``late``."""
    return events.withWatermark(at, late).groupBy(F.window(at, every), by).count()
