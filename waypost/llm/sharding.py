"""Sharding by a two-pass external shuffle.

Pass one scatters the rows: the document id and the number of shards decide
the shard (highest seeded hash wins, so one more shard takes rows only into
itself), and a second seeded hash deals a shard's rows evenly over buckets that
fit in a task's memory.  Pass two shuffles every bucket by Fisher-Yates and
writes it into its shard's folder.

Defined cases: a null id is an id of its own; a null text has no bytes;
repeated rows are all kept, and the scatter hash also takes the input partition, so
even a row repeated without end is spread over the buckets of its shard; input columns named like
the operator's own (``shard``, ``bucket``, ``position``, ``slot``) give way to
these; an empty table gives empty shards.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

BUCKET_BYTES = 64 << 20
OWN = ("shard", "bucket", "position", "slot")


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose seeded hash with the key is highest."""
    scores = F.array(*[F.xxhash64(F.lit(seed), F.lit(k), key) for k in range(n_shards)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def fisher_yates(columns: list[str], seed: int) -> Callable:
    """Shuffles one bucket.  Rows are first put in the order of their hashes, so the arrival order doesn't count."""

    def run(key, bucket):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(bucket.column("__hash").to_numpy(), kind="stable")
        rng = np.random.Generator(np.random.PCG64([seed, key[0].as_py(), key[1].as_py()]))
        rng.shuffle(order)  # Fisher-Yates
        out = bucket.select(columns).take(pa.array(order))
        n = out.num_rows
        return (
            out.append_column("bucket", pa.array(np.full(n, key[1].as_py(), dtype=np.int64)))
            .append_column("position", pa.array(np.arange(n, dtype=np.int64)))
            .append_column("shard", pa.array(np.full(n, key[0].as_py(), dtype=np.int32)))
        )

    return run


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of ``docs`` as Parquet to ``path/shard=k``."""
    spark = docs.sparkSession
    rows = shared.without(docs, *OWN)
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    shard = shard_of(key, n_shards, seed)
    sizes = dict(rows.groupBy(shard.alias("__shard")).agg(F.sum(shared.utf8_size(text) + 64)).collect())  # one row a shard
    least = math.ceil(2 * shared.shuffle_partitions(spark) / n_shards)
    buckets = F.array(*[F.lit(max(least, math.ceil(sizes.get(k, 0) / bucket_bytes))).cast("long") for k in range(n_shards)])
    dealt = rows.select(
        "*",
        F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]).alias("__hash"),
        shard.alias("__shard"),
    ).withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__hash"), F.spark_partition_id()), F.get(buckets, F.col("__shard"))))
    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("position", T.LongType()), T.StructField("shard", T.IntegerType())])
    shuffled = dealt.groupBy("__shard", "__bucket").applyInArrow(fisher_yates(rows.columns, seed), schema)
    shuffled.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, docs_schema: T.StructType, *derived: Column) -> DataFrame:
    """The rows of written shards, with ``shard`` and ``slot``, a row's gapless place in its shard.

    ``derived``: columns to take instead of the stored ones.
    """
    kept = [f for f in docs_schema.fields if f.name.lower() not in OWN]
    schema = T.StructType([*kept, T.StructField("bucket", T.LongType()), T.StructField("position", T.LongType()), T.StructField("shard", T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path)
    counts = stored.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = stored.select(*(derived or [F.col(f"`{f.name}`") for f in kept]), "shard", "bucket", "position")
    return rows.join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("position")).drop("first", "bucket", "position")


def op1_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """All ``documents`` in shards 0 to 7 under the law ``key``; derived from the written shards."""
    docs = shared.table(spark, sf_dir, "documents")
    path = shared.fresh_path(spark, "shards")
    write_shards(docs, path, n_shards, seed)
    text = F.col("text")
    rows = read_shards(
        spark, path, docs.schema,
        F.col("doc_id"), (shared.utf8_size(text) + 1).alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        shard_of(F.col("doc_id"), n_shards + 1, seed).alias("grown_shard"),
    )
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
