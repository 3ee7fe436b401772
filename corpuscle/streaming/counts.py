"""Incremental corpus counts: an extension beside the batch operators, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def language_counts(stream: DataFrame) -> DataFrame:
    """Documents, words and units by language; use with output mode ``complete`` or ``update``."""
    return stream.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(T.word_count("text")).alias("words"), F.sum(T.unit_count("text")).alias("faithful_units"))


def event_windows(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows of ``ts``, with late rows up to ``late``."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
