"""Subscriptions: the change log as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.functions import paths as P
from waypost.functions import values as V


def subscribe(spark: SparkSession, store_path: str, pattern: str, condition: Column | None = None, compat: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of changes whose path matches ``pattern``; ``condition`` is on endpoint columns."""
    reader = spark.readStream.schema(V.BATCHED_LOG_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(f"{store_path.rstrip('/')}/log").drop("batch").where(P.matching(P.parse(pattern, compat), compat))
    return rows if condition is None else rows.where(condition)


def change_counts(changes: DataFrame, window: str, lateness: str) -> DataFrame:
    """Changes by window of time and root; rows later than ``lateness`` don't change a finished window."""
    return changes.withWatermark("ts", lateness).groupBy(F.window("ts", window), "root").agg(F.count("*").alias("n"), F.count_if(F.col("deleted")).alias("removed"))
