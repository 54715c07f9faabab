"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half its shingles' hashes
have it.  For radius r every bit gets a non-zero vector of r + 1 bits, and every non-zero
vector v of r + 1 bits a mask: the bits whose vector has an odd overlap with v.
Any r differing bits span at most r dimensions, so some v is orthogonal to all of
their vectors: under its mask the two fingerprints agree, and the
2^(r+1) - 1 tables miss no pair within the radius.

Equal fingerprints count once.  A bucket of a table is compared in one task
when it holds few distinct fingerprints, and gives a spanning forest of links,
never all pairs.  The members of larger buckets are linked through
the fingerprints at half the radius from them: two are within the radius
exactly if such balls meet, a ball meets at most as many others as it has
points, and the work is in proportion to the members.  So nothing is capped.

Defined cases: null, empty and blank texts have fingerprint zero, linked like
any other; a text of fewer words than a shingle is one shingle; repeated rows
share a component; a null id takes part, and a component's id is the smallest
that isn't null; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components as cc
from . import hashing as H
from . import shared

BITS = 64
#: Distinct fingerprints of a bucket that one task compares with each other.
TASK_BUCKET = 4096
#: Rows of bucket members that a task is dealt, about.
MEMBERS_A_TASK = 1 << 20


def fingerprinter(k: int, n_keys: int) -> Callable:
    """Maps batches of key columns and a text to the key columns and the fingerprint."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        digest = xxhash.xxh64_intdigest

        def fingerprint(text):
            words = text.encode().translate(lower).split() if text else []
            if not words:
                return 0
            joined, n = b" ".join(words), len(words)
            if n <= k:
                return digest(joined, 42)
            lengths = np.fromiter(map(len, words), np.int64, n)
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
            return int(H.majority(hashes[None, :], [len(hashes)])[0])

        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(n_keys).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], pa.array(found)], [*batch.schema.names[:n_keys], "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keys`` of each document and its fingerprint as a signed long."""
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    return rows.mapInArrow(fingerprinter(words, len(keys)), f"{schema}, fp long")


def masks(radius: int) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits, as signed longs."""
    most = (1 << (radius + 1)) - 1
    vectors = [i % most + 1 for i in range(BITS)]
    out = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, most + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def bucket_links(radius: int) -> Callable:
    """Batches sorted by bucket to the links of a spanning forest of each bucket."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def forest(members):
            out, rest = [], members
            while len(rest) > 1:
                root, frontier, rest = rest[:1], rest[:1], rest[1:]
                while len(frontier) and len(rest):
                    near = np.zeros(len(rest), bool)
                    for i in range(0, len(frontier), 256):
                        near |= (np.bitwise_count(frontier[i : i + 256, None] ^ rest[None, :]) <= radius).any(axis=0)
                    frontier, rest = rest[near], rest[~near]
                    if len(frontier):
                        out.append(np.stack([frontier, np.broadcast_to(root, frontier.shape)]))
            return out

        def links(table, key, fp):
            new = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.concatenate([starts, [len(fp)]]))
            pairs = starts[sizes == 2]
            a, b = fp[pairs], fp[pairs + 1]
            near = np.bitwise_count(a ^ b) <= radius
            out = [np.stack([a[near], b[near]])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                out += forest(fp[s : s + n])
            found = np.unique(np.concatenate(out, axis=1), axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield links(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None:
            yield links(*held)

    return run


def ball(fp, half: int):
    """All fingerprints at most ``half`` (1 or 2) bits away."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    every = F.sequence(F.lit(0), F.lit(BITS - 1))
    flips = F.transform(every, one) if half == 1 else F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, F.lit(BITS - 1)), lambda j: one(i).bitwiseOR(one(j)))))
    return F.transform(F.concat(F.array(F.lit(0).cast("long")), flips), lambda m: fp.bitwiseXOR(m))


def near_links(fps: DataFrame, radius: int = 4, task_bucket: int = TASK_BUCKET) -> DataFrame:
    """Links a, b between distinct fingerprints of ``fps`` (column fp) that connect exactly those within ``radius`` bits."""
    if radius not in (2, 4):
        raise ValueError("the radius is 2 or 4")
    spark = fps.sparkSession
    distinct = shared.written(fps.select("fp").distinct(), "fingerprints")
    table = F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks(radius)])).alias("t", "mask")
    keyed = distinct.select("fp", table).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    shared_keys = shared.written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    small, large = shared_keys.where(F.col("n") <= task_bucket), shared_keys.where(F.col("n") > task_bucket)
    members = keyed.join(small.select("t", "key"), ["t", "key"])
    tasks = max(shared.shuffle_partitions(spark), -(-(small.agg(F.sum("n")).first()[0] or 0) // MEMBERS_A_TASK))
    dealt = members.repartition(tasks, "t", "key").sortWithinPartitions("t", "key", "fp")
    found = dealt.mapInArrow(bucket_links(radius), "a long, b long")
    if not large.isEmpty():
        crowded = keyed.join(large.select("t", "key"), ["t", "key"]).select("fp").distinct()
        met = shared.written(crowded.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("at")), "balls")
        centre = met.groupBy("at").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("at", "low")
        found = found.union(met.join(centre, "at").where("fp != low").select("fp", "low").distinct())
    return found


def groups(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``fps`` (a written table with column fp) with ``label``, equal within a group of linked fingerprints."""
    roots = cc.components(near_links(fps, radius))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``fp`` and ``component_id``, the smallest id that links lead to."""
    fps = shared.written(fingerprints(docs, words, (id_col,), text_col), "documents-fp")
    labelled = shared.written(groups(fps, radius), "labels")
    least = shared.written(labelled.groupBy("label").agg(F.min(id_col).alias("component_id")), "least")
    return labelled.join(least, "label").select(id_col, "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``: 4-word shingles, 4 bits."""
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
