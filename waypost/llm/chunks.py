"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: shift left, add the byte's random
number.  Its top bits depend on the last 32 bytes only, and a chunk ends where they are
zero, so chunks inside a repeated passage are the same wherever it
stands, and insertions before it move nothing.  Chunks are grouped by digest and length.
Those found in more than one document are joined back, and neighbours form
runs: repeated passages.  The ends of a passage are inside the chunks next to its run, or up to 31 bytes before, so a
run of at least ``LEAST_RUN`` code points is
reported if with these it has ``LEAST_WORDS`` words: no longer passage is lost to where
chunks end, and few shorter ones are taken in.  It is
reported in pieces where only part of it stands in a lower document: chunks of
which this document is the lowest are kept (and reported from ``LEAST_RUN`` code
points on), the others can be cut, so no chunk is gone from all documents.

Defined cases: null and empty texts have no chunks; documents are told apart by
id and text (by the id itself and a hash of both), so a row repeated entirely counts as one document, and its repeats
are reported once; null ids sort first; a text without any end of a chunk (one byte repeated) is cut at every
``LONGEST`` bytes; other columns are not looked at; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing as H
from . import shared

#: One byte in so many ends a chunk.
AVERAGE = 32
SHORTEST, LONGEST = 8, 1024
LEAST_RUN, LEAST_WORDS = 30, 50
#: Bytes before a passage that still count in the hash at its beginning.
WINDOW = 31
#: Documents and bytes of text that are cut at once.
DOCS_AT_ONCE, BYTES_AT_ONCE = 1000, 4 << 20


def chunk_ends(data, average: int = AVERAGE):
    """Ends (exclusive) of the chunks of some bytes, the last byte's included."""
    import numpy as np

    n = len(data)
    h = H.GEAR[data]
    for step in (1, 2, 4, 8, 16):  # sums over windows of 2, 4, 8, 16, 32 bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    whole = np.append(data[1:] & 0xC0 != 0x80, True)  # no character is split
    ends = np.flatnonzero((h >> np.uint32(32 - (average.bit_length() - 1)) == 0) & whole) + 1
    if len(ends):
        ends = ends[np.diff(ends, prepend=-SHORTEST) >= SHORTEST]
    ends = np.append(ends[ends < n], n)
    wide = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if len(wide):
        starts = np.concatenate([[0], ends[:-1]])
        more = np.concatenate([np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in wide.tolist()])
        following = np.append(np.flatnonzero(whole) + 1, n)
        ends = np.unique(np.append(ends, following[np.searchsorted(following, more)]))
    return ends


def chunker(batches):
    """(doc_id, key, text) to (doc_id, key, start, length, digest, words, before, after) of every chunk; code points, words that begin in it, in the one before and the bytes whose sums reach into that, and in the one after."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part in shared.slices(batch, 2, DOCS_AT_ONCE, BYTES_AT_ONCE):
            rows, starts, lengths, digests, words = [], [], [], [], ([], [], [])
            for text in part.column(2).to_pylist():
                raw = (text or "").encode()
                rows.append(0)
                if not raw:
                    continue
                data = np.frombuffer(raw, np.uint8)
                ends = chunk_ends(data)
                begins = np.concatenate([[0], ends[:-1]])
                if len(raw) == len(text):
                    at, to = begins, ends
                else:
                    before = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
                    at, to = before[begins], before[ends]
                first = H.runs(~H.BLANK[data])[0]
                place = np.searchsorted(first, np.append(begins, len(raw)))
                n = np.diff(place)
                reach = np.searchsorted(first, np.maximum(np.append(0, begins[:-1]) - WINDOW, 0))
                rows[-1] = len(ends)
                starts.append(at)
                lengths.append(to - at)
                for out, x in zip(words, (n, place[:-1] - reach, np.append(n[1:], 0)), strict=True):
                    out.append(x)
                digests += [digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            which = pa.array(np.repeat(np.arange(part.num_rows), rows))
            flat = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
            columns = [part.column(0).take(which), part.column(1).take(which), flat(starts, np.int64), flat(lengths, np.int32), pa.array(np.array(digests, np.uint64).view(np.int64)), *(flat(x, np.int16) for x in words)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "start", "length", "digest", "words", "before", "after"])


def repeats(docs: DataFrame, least_run: int = LEAST_RUN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per repeated passage, or piece of one whose chunks are alike in being kept: doc_id, key, start, end (code points, exclusive), n_chunks, first_doc_id (the lowest id with any of its chunks), kept."""
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    chunks = shared.written(rows.mapInArrow(chunker, "doc_id long, key long, start long, length int, digest long, words short, before short, after short"), "chunks")
    lowest = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ends = {f"{name}_{c}": of(x) for name, of in (("least", F.min), ("most", F.max)) for c, x in (("id", lowest), ("key", F.col("key")))}
    groups = chunks.groupBy("digest", "length").agg(*[c.alias(name) for name, c in ends.items()])  # plain numbers, which are hashed and not sorted
    several = "least_id != most_id OR least_key != most_key"
    common = shared.written(groups.where(several).select("digest", "length", F.col("least_id").alias("first")), "common")
    columns = ["doc_id", "key", "start", "length", "words", "before", "after", "first"]
    found = chunks.join(common, ["digest", "length"]).select(*columns).groupBy("doc_id", "key", "start").agg(*[F.min(c).alias(c) for c in columns[3:]])  # repeated rows count once
    order = Window.partitionBy("doc_id", "key").orderBy("start")
    fresh = (F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.lit(-1))).cast("long")
    run = F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy("doc_id", "key", "run")
    in_order = within.orderBy("start")
    turn = (F.col("kept") != F.coalesce(F.lag("kept").over(in_order), F.col("kept"))).cast("long")
    whole = F.max(F.col("start") + F.col("length")).over(within) - F.min("start").over(within)
    edges = F.min(F.struct("start", "before")).over(within)["before"] + F.max(F.struct("start", "after")).over(within)["after"]
    marked = found.withColumn("run", run).withColumns({"kept": lowest == F.col("first")}).withColumns({"turn": turn, "whole": whole, "most_words": F.sum("words").over(within) + edges})
    long = marked.where((F.col("whole") >= least_run) & (F.col("most_words") >= least_words))
    pieces = long.withColumn("piece", F.sum("turn").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = pieces.groupBy("doc_id", "key", "run", "piece", "kept").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.count("*").alias("n_chunks"), F.min("first").alias("first"))
    return joined.where(~F.col("kept") | (F.col("end") - F.col("start") >= least_run)).select("doc_id", "key", "start", "end", "n_chunks", F.when(F.col("first") != -(1 << 63), F.col("first")).alias("first_doc_id"), "kept")


def without_repeats(docs: DataFrame, least_run: int = LEAST_RUN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut from all texts but those of the lowest id."""
    cut = repeats(docs, least_run, least_words, id_col, text_col).where("not kept").groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    text = F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    cuts = shared.written(cut, "cuts").withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    own = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))
    both = own.join(cuts, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")), "left")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts.end"))
    ends = F.concat(F.col("cuts.start"), F.array(F.char_length("text").cast("long")))
    pieces = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.substring("text", (x["b"] + 1).cast("int"), (x["e"] - x["b"]).cast("int")))
    left = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    return both.select(*[left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all ``documents`` that repeat across them."""
    return repeats(shared.table(spark, sf_dir, "documents")).drop("key")
