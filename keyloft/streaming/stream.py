"""Streams of records: the loaders' parsing over Structured Streaming.

Parsers keep no state between records, so a stream goes through the same
expressions as a batch.  Watermarks and windows are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.table import RAW


def read_records(spark: SparkSession, path: str, *, terminator: str = "\n", max_files: int | None = None) -> DataFrame:
    """Records of the files that come into a folder, as a stream with column ``value``."""
    reader = spark.readStream.format("text").option("lineSep", terminator)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def parsed(stream: DataFrame, extractor: Callable[[Column], Column], *keep: str) -> DataFrame:
    """A stream with the vmap of each record in ``__raw__``; refused records, null ones, are dropped."""
    return stream.select(*keep, extractor(F.col("value")).alias(RAW)).filter(F.col(RAW).isNotNull())


def windowed_counts(stream: DataFrame, time: Column, key: Column, *, width: str, late: str) -> DataFrame:
    """Records by window of event time and key; those later than ``late`` are left out."""
    timed = stream.select(time.alias("ts"), key.alias("key")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n"))
