"""Near-duplicates: SimHash by covering fingerprints as in ``simhash``, widened by MinHash, confirmed by the exact Jaccard similarity of five-word shingles.

A text's fingerprint has a bit set where more than half of its shingles' hashes have
it, and the masks of ``simhash`` cover every difference of up to ``RADIUS`` bits: two fingerprints within
it agree under one of 31 masks at least, so these tables miss no such pair.
A limit on the similarity reaches further than any radius that tables can cover: at a
Jaccard similarity of 0.8 two fingerprints of 64 bits differ in 9.7 bits on average, with a deviation of 2.9,
and to find nine in ten such pairs a covering of 13 bits needs 16,383 masks for each text.
So beside its masked fingerprints a text has ``BANDS`` keys, each of the
lowest values that ``ROWS`` hash functions take on its shingles.  Two texts of Jaccard
similarity J agree in a key with probability J^ROWS, wherever they differ: at 0.8 a pair
shares no key in 3 cases of a million, above in fewer.  Both kinds of keys make buckets
alike; what follows does not tell them apart.

Every link is confirmed by the shingle sets.  First each member of a bucket (band, key)
is compared with the bucket's lowest.  A bucket of three and more members that these
links, of all buckets together, don't connect is then compared pair by pair, less the pairs already
connected.  A bucket of more than ``TASK_BUCKET`` members, or of more than ``BLOCK_SHINGLES``
shingles, is cut into blocks, and every pair of blocks is compared at once; no pair is
lost, and no task holds more than two blocks, whatever the texts' lengths.

Defined cases: texts of fewer than five words are one shingle; texts without words
are equal to each other; repeated shingles count once; upper and lower case ASCII
are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as cc
from . import hashing as H
from . import shared, simhash

#: Bits within which the fingerprints' tables miss no pair.
RADIUS = 4
BANDS, ROWS = 24, 4
LEAST_SIMILARITY = 0.8
WORDS = 5
TASK_BUCKET = 500
#: Shingles of a block, about; a longer text is more by itself.
BLOCK_SHINGLES = 1 << 19
#: Hashes computed at once.
STEP = 1 << 13
#: Texts, and bytes of them, of which shingle sets are held at once.
DOCS_AT_ONCE, BYTES_AT_ONCE = 500, 4 << 20
#: Rows of bucket members that a task is dealt, about.
MEMBERS_A_TASK = 20_000


def shingle_set(text):
    """The hashes of a text's shingles, sorted, each once; none for a text without words."""
    import numpy as np

    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    data = np.frombuffer((text or "").encode().translate(lower), np.uint8)
    starts, ends = H.runs(~H.BLANK[data])
    return np.unique(H.windows(H.word_hashes(data, starts, ends), min(WORDS, len(starts)))) if len(starts) else np.zeros(0, np.uint64)


def fingerprint(found) -> int:
    """SimHash of a shingle set; zero for none."""
    return int(H.majority(found[None, :], [len(found)])[0])


def banded(n_keys: int, n_bands: int = BANDS) -> Callable:
    """Maps batches of key columns and a text to the keys, ``node`` (equal for equal shingle sets), ``fp``, the fingerprint, and ``bands``, the MinHash keys."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        seeds = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 63, n_bands * ROWS).astype(np.uint64)[:, None]

        def sketch(text):
            found = shingle_set(text)
            least = np.full(n_bands * ROWS, (1 << 64) - 1, np.uint64)
            for i in range(0, len(found), STEP):
                np.minimum(least, H.mixed(found[None, i : i + STEP] ^ seeds).min(axis=1), out=least)
            keys = np.zeros(n_bands, np.uint64)
            for row in least.reshape(n_bands, ROWS).T:
                keys = keys * H.BASE + row
            return xxhash.xxh3_64_intdigest(found.tobytes()), fingerprint(found), H.mixed(keys)

        for batch in batches:
            for part in shared.slices(batch, n_keys, DOCS_AT_ONCE, BYTES_AT_ONCE):
                found = [sketch(t) for t in part.column(n_keys).to_pylist()]
                nodes, fps = (np.array([x[i] for x in found], np.uint64).view(np.int64) for i in (0, 1))
                flat = np.concatenate([x[2] for x in found]).view(np.int64)
                bands = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * n_bands, pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keys], pa.array(nodes), pa.array(fps), bands], [*part.schema.names[:n_keys], "node", "fp", "bands"])

    return run


def shingled(batches):
    """(node, text) to (node, size, shingles)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in shared.slices(batch, 1, DOCS_AT_ONCE, BYTES_AT_ONCE):
            sets = [shingle_set(t) for t in part.column(1).to_pylist()]
            sizes = [len(s) for s in sets]
            offsets = np.cumsum([0, *sizes]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), lists], ["node", "size", "shingles"])


def links_of_buckets(similarity: float) -> Callable:
    """Rows of a bucket's members (bucket, block, node, root, shingles), sorted by bucket, to links (a, b) that connect those of different roots exactly as all similar pairs do."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(nodes, roots, sets):
            roots = np.unique(roots, return_inverse=True)[1]
            sizes = np.array([len(s) for s in sets])
            which = np.unique(np.concatenate(sets), return_inverse=True)[1]
            at = np.concatenate([[0], np.cumsum(sizes)])
            member = np.zeros(len(which), bool)
            out = []
            for i in range(len(nodes) - 1):
                if (roots[i + 1 :] == roots[i]).all():
                    continue
                mine = which[at[i] : at[i + 1]]
                member[mine] = True
                both = np.add.reduceat(member[which[at[i + 1] :]], at[i + 1 : -1] - at[i + 1], dtype=np.int64)
                member[mine] = False
                near = both >= similarity * (sizes[i] + sizes[i + 1 :] - both) - 1e-9
                for j in (np.flatnonzero(near & (roots[i + 1 :] != roots[i])) + i + 1).tolist():
                    if roots[j] != roots[i]:
                        out.append((nodes[i], nodes[j]))
                        roots[roots == roots[j]] = roots[i]
            return out

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        held, at = [], None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:4]]
            for bucket, block, node, root, shingles in zip(*columns, batch.column(4), strict=True):
                if (bucket, block) != at and held:
                    yield batch_of(links(*zip(*held, strict=True)))
                    held = []
                at = (bucket, block)
                held.append((node, root, shingles.values.to_numpy()))
        if held:
            yield batch_of(links(*zip(*held, strict=True)))

    return run


def similar(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``ok``: whether their shingle sets have this Jaccard similarity."""
    one = pairs.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.select("a", "b", (both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).alias("ok"))


def roots_of(rows: DataFrame, docs: DataFrame, similarity: float, text_col: str, task_bucket: int, block_shingles: int, radius: int) -> DataFrame:
    """node, root of all nodes of ``rows`` (h1, h2, node, fp, bands) that are not their group's root."""
    distinct = shared.written(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min(F.struct("h1", "h2")).alias("x")), "distinct")
    masked = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in simhash.masks(radius)])
    keyed = distinct.select("node", F.posexplode(F.concat(masked, "bands")).alias("t", "key"))
    sums = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    # buckets of the same members count once
    buckets = shared.written(sums.groupBy("n", "low", "x", "y").agg(F.min(F.struct("t", "key")).alias("k")).select("k.t", "k.key", "n", "low"), "buckets")
    members = shared.written(keyed.join(buckets, ["t", "key"]).withColumn("bucket", F.xxhash64("t", "key")).select("bucket", "n", "low", "node"), "members")
    pairs = shared.written(members.where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    needed = distinct.join(members.select("node").distinct(), "node", "left_semi").select("node", "x.h1", "x.h2")
    needed = shared.written(needed, "needed")
    texts = docs.select(shared.row_hash(docs, 1).alias("h1"), shared.row_hash(docs, 2).alias("h2"), F.col(f"`{text_col}`").alias("text"))
    texts = shared.with_filter(texts, needed, "h1").where("maybe").select("h1", "h2", "text").join(needed, ["h1", "h2"])
    sets = texts.select("node", "text").mapInArrow(shingled, "node long, size long, shingles array<long>").dropDuplicates(["node"])
    shingles = shared.written(sets, "shingles")
    tested = shared.written(similar(pairs, shingles, similarity), "tested")
    good = tested.where("ok").select("a", "b")
    roots = shared.written(cc.components(good), "roots")
    sized = members.where("n > 2").join(shingles.select("node", "size"), "node").join(roots, "node", "left")
    open_ = shared.written(sized.select("bucket", "n", "node", "size", F.coalesce("root", "node").alias("root")), "open")
    # blocks of a bucket: block i goes to the tasks of all pairs (i, j); a small bucket is one pair
    blocks = F.greatest(F.ceil(F.col("n") / task_bucket), F.least("n", F.ceil(F.col("total") / block_shingles)))
    spans = open_.groupBy("bucket", "n").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.sum("size").alias("total")).where("p != q")
    apart = shared.written(spans.select("bucket", "n", F.greatest(blocks, F.lit(1)).cast("long").alias("blocks")), "apart")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    placed = open_.drop("n").join(apart, "bucket").select("bucket", F.explode(pair).alias("block"), "node", "root").join(shingles, "node")
    rows_out = apart.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    tasks = max(shared.shuffle_partitions(docs.sparkSession), -(-rows_out // MEMBERS_A_TASK))
    dealt = placed.select("bucket", "block", "node", "root", "shingles").repartition(tasks, "bucket", "block").sortWithinPartitions("bucket", "block", "node")
    more = shared.written(dealt.mapInArrow(links_of_buckets(similarity), "a long, b long"), "links")
    return roots if more.isEmpty() else cc.components(good.union(more))


def one_of_each(docs: DataFrame, similarity: float = LEAST_SIMILARITY, id_col: str = "doc_id", text_col: str = "text", task_bucket: int = TASK_BUCKET, block_shingles: int = BLOCK_SHINGLES, radius: int = RADIUS, n_bands: int = BANDS) -> DataFrame:
    """The rows of ``docs``, of each group of near-duplicates only the one of the lowest id (null is lowest).

    ``n_bands`` 0: by the fingerprints within ``radius`` bits alone.
    """
    keys = docs.select(F.col(f"`{id_col}`").alias("id"), shared.row_hash(docs, 1).alias("h1"), shared.row_hash(docs, 2).alias("h2"), F.col(f"`{text_col}`").alias("text"))
    kind = keys.schema["id"].dataType.simpleString()
    rows = shared.written(keys.mapInArrow(banded(3, n_bands), f"id {kind}, h1 long, h2 long, node long, fp long, bands array<long>"), "sketches")
    roots = roots_of(rows, docs, similarity, text_col, task_bucket, block_shingles, radius)
    labelled = rows.join(roots, "node", "left").select("id", "h1", "h2", F.coalesce("root", "node").alias("label"))
    first = labelled.groupBy("label").agg(F.min(F.struct("id", "h1", "h2")).alias("x"))
    times = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    kept = first.select("x.h1", "x.h2").join(shared.written(times, "times"), ["h1", "h2"])
    return shared.rows_with(docs, shared.written(kept, "kept")).select("row.*")
