"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space and words as the contracts of this subpackage define them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: list[str] = []
_paths: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="waypost-"))
        at = _own_dir[0]
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    _paths.append(f"{shared_dir(spark)}/waypost/{label}-{uuid.uuid4().hex}")
    return _paths[-1]


def forget(spark: SparkSession) -> None:
    """Deletes all tables and files that operators of this process wrote on the way; for when their results have been stored."""
    for path in _paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _paths.clear()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch, column: int, rows: int, size: int) -> Iterator:
    """Pieces of an Arrow batch of at most ``rows`` rows and about ``size`` bytes in a text column; a longer text is a piece by itself."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    bytes_to = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = bytes_to[first - 1] if first else 0
        last = min(first + rows, max(first + 1, int(np.searchsorted(bytes_to, before + size, side="right"))))
        yield batch.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()  # of the batches before; a worker outlives its task


def labelled_texts(docs: DataFrame, known: DataFrame, rows: int, size: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, y, text) of a bounded sample of the labelled rows ``known`` (id, y; each id once), a text for each id.

    The rows of the lowest seeded hashes of their ids, ``h``: at most ``rows``, and those
    before which less than ``size`` bytes of text have been taken.  So the sample is
    uniform whatever the texts' lengths, and its size is bounded by the two and one text.
    """
    ranked = known.select("id", "y", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h", "id").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ranked), "id")  # a bounded number of ids
    found = written(texts.groupBy("id", "h", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    before = F.coalesce(F.sum("size").over(Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = found.select("id", "h", utf8_size(F.col("text")).alias("size"))  # no more than the sample's ids
    within = sizes.select("id", before.alias("before")).where(F.col("before") < size).select("id")
    return found.join(F.broadcast(within), "id")


def fitted(sample: DataFrame, fit: Callable, *order: str):
    """What ``fit`` makes of the Arrow batches of a bounded sample, in the order of some columns.

    One task of an executor holds the sample and trains; the driver gets the model
    alone, and a lost executor costs one training.  None for an empty sample.
    """

    def run(batches):
        import pickle

        import pyarrow as pa

        model = pickle.dumps(fit(batches))
        pa.default_memory_pool().release_unused()  # the worker outlives its task
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    import pickle

    found = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def row_hash(df: DataFrame, seed: int) -> Column:
    """A hash over all columns of a row that can be hashed."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def rows_with(df: DataFrame, chosen: DataFrame, *more: str) -> DataFrame:
    """The distinct rows of ``df`` whose two row hashes (seeds 1 and 2) are in ``chosen`` as h1, h2, with columns ``more`` of it.

    ``chosen`` is a written table; its ``n`` is how often the row occurs.  Rows
    that occur once, nearly all, take part in one join only.  Result: row, more.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = df.select(row.alias("row"), row_hash(df, 1).alias("h1"), row_hash(df, 2).alias("h2")).join(chosen, ["h1", "h2"])
    return found.where("n = 1").select("row", *more).union(found.where("n > 1").dropDuplicates(["h1", "h2"]).select("row", *more))


#: Bits of the filter that goes to all tasks: 65,536 rows of 64, half a megabyte, whatever the input.
FILTER_BITS = 1 << 22


def with_filter(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``maybe``: false only where the long ``key`` is not in ``keys``, which has a column of that name.

    A bitmap of fixed size by the key's low bits.  With many more keys than
    bits it filters little, but nothing becomes wrong.
    """
    low = F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1))
    slot, bit = F.shiftright(low, 6).alias("__slot"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = keys.groupBy(slot).agg(F.bit_or(bit).alias("__bits"))
    found = df.withColumn("__slot", slot).join(F.broadcast(bitmap), "__slot", "left")
    return found.withColumn("maybe", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__slot", "__bits")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts of nothing but ASCII by the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: The longest array that repeating a row makes.
STEP = 4096


def expanded(df: DataFrame, n: Column, most: int, step: int = STEP) -> DataFrame:
    """Each row ``n`` times with ``nth`` from 1; ``most``: an upper bound of n.

    A row repeated without end is unfolded level by level, by arrays of at most
    ``step``, and its parts are dealt over all tasks in between.
    """
    rows, level = df.withColumns({"__from": F.lit(0).cast("long"), "__n": n.cast("long")}).where("__n > 0"), 0
    while step ** (level + 1) < most:
        level += 1
    for k in range(level, -1, -1):
        unit = step**k
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / unit).cast("long")))
        rows = rows.withColumn("__i", part).withColumns({"__from": F.col("__from") + F.col("__i") * unit, "__n": F.least(F.lit(unit), F.col("__n") - F.col("__i") * unit)}).drop("__i")
        if k:
            rows = rows.repartition(shuffle_partitions(df.sparkSession))
    return rows.withColumn("nth", F.col("__from") + 1).drop("__from", "__n")


def ranked(rows: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in a total order, and the sums over the rows before.

    Rows are dealt by range of the order; only a row for each partition is ever in one task.
    """
    n = shuffle_partitions(rows.sparkSession)
    dealt = written(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), label)
    sums = {"place": F.lit(1).cast("long"), **sums}
    per = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = per.select("__part", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(offsets), "__part")  # as many rows as partitions
    return joined.select(*[F.col(c) for c in rows.columns], *[(F.col(f"__{k}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(k) for k, c in sums.items()])


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator's own output takes."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
