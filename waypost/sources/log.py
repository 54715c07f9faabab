"""The change log: endpoints with a sequence number, a tombstone flag and a time.

A write or a deletion is a row; the current state of a path is its row of the
highest number; of rows of one batch with one number, the one of the highest hash of its value.  Files are partitioned by batch and root, so a scan below a literal head
reads one folder of each batch since the base.  A base and a log written after it make compaction an
ordinary write to a new folder; what was before stays readable for history and snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.functions import values as V

ENDPOINT = [f.name for f in V.ENDPOINT_SCHEMA.fields]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], V.LOG_SCHEMA)


def as_log(ep: DataFrame, seq: int = 0) -> DataFrame:
    return ep.select(*ENDPOINT, F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("deleted"), F.current_timestamp().alias("ts"))


def current(log: DataFrame, until_seq: int | None = None, as_of=None) -> DataFrame:
    """Endpoints as they stand, or stood after change ``until_seq`` or at the time ``as_of``."""
    rows = log if until_seq is None else log.where(F.col("seq") <= until_seq)
    rows = rows if as_of is None else rows.where(F.col("ts") <= F.lit(as_of))
    state = F.struct(*[c for c in ENDPOINT if c not in ("root", "path")], "deleted")
    last = rows.groupBy("root", "path").agg(F.max_by(state, F.struct("seq", F.xxhash64("deleted", *V.VALUE_COLUMNS))).alias("s"))
    return last.where("NOT s.deleted").select(*[F.col(c) if c in ("root", "path") else F.col(f"s.{c}").alias(c) for c in ENDPOINT])


def history(log: DataFrame, path: str, first=None, last=None) -> DataFrame:
    """All changes of one path in order, within times where given."""
    rows = log.where(F.col("path") == path)
    rows = rows if first is None else rows.where(F.col("ts") >= F.lit(first))
    rows = rows if last is None else rows.where(F.col("ts") <= F.lit(last))
    return rows.orderBy("seq")


def stats(log: DataFrame) -> DataFrame:
    """One row: total_operations, total_adds, total_removes."""
    return log.agg(F.count("*").alias("total_operations"), F.count_if(~F.col("deleted")).alias("total_adds"), F.count_if(F.col("deleted")).alias("total_removes"))


def write(log: DataFrame, path: str, batch: int) -> None:
    log.sortWithinPartitions("root", "path").write.mode("overwrite").partitionBy("root").parquet(f"{path}/batch={batch}")


def read(spark: SparkSession, path: str, after: int = -1, but: list[int] | None = None) -> DataFrame:
    """The log's rows of batches beyond number ``after`` that are not among the unfinished ones of ``but``."""
    names = [f.name for f in V.LOG_SCHEMA.fields]
    rows = spark.read.schema(V.BATCHED_LOG_SCHEMA).parquet(path).where(F.col("batch") > after)
    return (rows.where(~F.col("batch").isin(but)) if but else rows).select(*names)
