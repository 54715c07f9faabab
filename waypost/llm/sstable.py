"""Token ids as sorted-string-table shards.

A shard file holds documents in ascending key order::

    magic                     8 bytes
    data block *              entries, then crc32 of them (u32)
      entry                   varint shared, varint rest, varint n_ids, key[shared:], ids
    block index               per block: varint key length, key, u64 offset, u32 length, u64 ids before
    Bloom filter              bits of a power-of-two length, 7 probes
    footer                    u64 index offset, u64 filter offset, u64 documents, u64 ids, u32 id width, u32 crc32 of index and filter, magic

Keys share prefixes within a block; a block's first key is whole.  Ids take two
bytes where the vocabulary allows it, else four (little-endian).  All files of
a table follow each other in key order.  The manifest has every shard's first and last key; a
lookup opens only shards whose range holds the key, asks the filter, and finds the block by binary
search of the index.

Defined cases: a null id sorts first; a null text is empty and holds only the
end id; repeated ids stay, ordered by a hash of the text, and a lookup returns
all of them; an empty table writes no shard.  Only the id and text columns are
stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

MAGIC = b"WPSST\x00\x00\x01"
BLOCK_BYTES = 256 << 10
SHARD_BYTES = 64 << 20
#: Bytes that a worker's memory of encoded words takes before it starts anew; longer words are not remembered.
MEMORY_BYTES = 128 << 20
LONG_WORD = 256
#: Documents and bytes of text that are encoded at once.
DOCS_AT_ONCE, BYTES_AT_ONCE = 500, 4 << 20
FOOTER = "<QQQQII8s"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(7)]


class ShardWriter:
    """Writes one shard as its documents arrive; nothing but the index and the keys' filter stays in memory."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = out.write(MAGIC) or len(MAGIC)
        self.block, self.block_key, self.last = bytearray(), b"", b""
        self.block_before = self.docs = self.ids = 0
        self.index = bytearray()
        self.hashes: list[bytes] = []

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.block:
            self.block_key, self.block_before, same = key, self.ids, 0
        else:
            same = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        n = len(ids) // self.width
        self.block += varint(same) + varint(len(key) - same) + varint(n) + key[same:]
        self.block += ids
        self.last = key
        self.docs += 1
        self.ids += n
        self.hashes.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.end_block()

    def end_block(self) -> None:
        import zlib

        if self.block:
            self.block += zlib.crc32(self.block).to_bytes(4, "little")
            self.out.write(bytes(self.block))
            self.index += varint(len(self.block_key)) + self.block_key + self.at.to_bytes(8, "little") + len(self.block).to_bytes(4, "little") + self.block_before.to_bytes(8, "little")
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        import struct
        import zlib

        self.end_block()
        bits = 1 << max(10, (10 * len(self.hashes)).bit_length())
        bloom = bytearray(bits // 8)
        for key in self.hashes:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = bytes(self.index) + bytes(bloom)
        self.out.write(tail + struct.pack(FOOTER, self.at, self.at + len(self.index), self.docs, self.ids, self.width, zlib.crc32(tail), MAGIC))
        self.out.close()


class ShardReader:
    """Reads a shard: all of it block by block, or one key by filter, index and one block."""

    def __init__(self, file, size: int):
        import struct
        import zlib

        self.file = file
        length = struct.calcsize(FOOTER)
        self.index_at, bloom_at, self.docs, self.ids, self.width, crc, magic = struct.unpack(FOOTER, self.read_at(size - length, length))
        tail = self.read_at(self.index_at, size - length - self.index_at)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a whole shard")
        index, self.bloom = tail[: bloom_at - self.index_at], tail[bloom_at - self.index_at :]
        self.keys, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = read_varint(index, at)
            self.keys.append(index[at : at + n])
            at += n
            self.blocks.append((int.from_bytes(index[at : at + 8], "little"), int.from_bytes(index[at + 8 : at + 12], "little"), int.from_bytes(index[at + 12 : at + 20], "little")))
            at += 20

    def read_at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, int, memoryview]]:
        """Key, ids before it in this shard, and ids of each document of a block."""
        import zlib

        at, length, before = self.blocks[block]
        data = memoryview(self.read_at(at, length))
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("a damaged block")
        at, last = 0, b""
        while at < length - 4:
            same, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            last = last[:same] + bytes(data[at : at + rest])
            at += rest
            yield last, before, data[at : at + n * self.width]
            at += n * self.width
            before += n

    def get(self, key: bytes) -> list[tuple[int, memoryview]]:
        """Every document stored under ``key``: ids before it, and its ids."""
        from bisect import bisect_left

        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, bits)):
            return []
        found, block = [], max(0, bisect_left(self.keys, key) - 1)
        while block < len(self.blocks) and self.keys[block] <= key:
            found += [(before, ids) for k, before, ids in self.entries(block) if k == key]
            block += 1
        return found


class WordEncoder:
    """A tokenizer's ids of whole texts, with every distinct word encoded once.

    Byte-level pre-tokenization always parts a text before a space, and around a
    line end, between two characters that are not white space, so the ids of the
    parts, joined, are the ids of the text.  A word of plain letters, less one mark at its end, is
    one unit of the pre-tokenization and goes straight to the model, any other word
    to the tokenizer; a text whose spaces touch other white space is split by
    pattern instead.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        #: Ids of words after a space, and of words that begin a text or line.
        self.memory, self.first = Words(self, " "), Words(self, "")
        self.odd = re.compile(r"\A\s|\s\Z|\A\Z").search
        self.parts = re.compile(r"(?<=\S) (?=\S)").split
        self.letters = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+([.,;:!?]?)").fullmatch
        self.model = self.tokenizer.model
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0].to_bytes(self.width, "little")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        self.symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.ids = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,;:!?"} | {"": []}

    def word(self, word: str, mark: str, space: str) -> bytes:
        """Ids of a word of letters with its end mark, after a space or nothing."""
        import array

        stem = word[: len(word) - len(mark)] if mark else word
        unit = ("\u0120" if space else "") + (stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.symbols))
        return array.array("H" if self.width == 2 else "I", [t.id for t in self.model.tokenize(unit)] + self.ids[mark]).tobytes()

    def raw(self, texts: list[str]) -> list[bytes]:
        import array

        kind = "H" if self.width == 2 else "I"
        return [array.array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        for memory in (self.memory, self.first):
            memory.shrink()
        out, first, get = [], self.first.__getitem__, self.memory.__getitem__
        for text in texts:
            try:
                lines = [line.split(" ") for line in text.split("\n")]
                out.append(self.newline.join([b"".join([first(p[0]), *map(get, p[1:])]) for p in lines]) if text else b"")
            except TypeError:
                pieces = self.parts(text)
                out.append(b"".join(self.raw([pieces[0], *(" " + x for x in pieces[1:])])))
        return out


class Words(dict):
    """Ids of words that follow ``space``, made when first asked for; None where white space meets white space or an end of the text."""

    def __init__(self, encoder: WordEncoder, space: str):
        super().__init__()
        self.encoder, self.space, self.bytes = encoder, space, 0

    def shrink(self) -> None:
        if self.bytes > MEMORY_BYTES:
            self.clear()
            self.bytes = 0

    def __missing__(self, word: str) -> bytes | None:
        e = self.encoder
        if m := e.letters(word):
            found = e.word(word, m[1], self.space)
        else:
            found = None if e.odd(word) else e.raw([self.space + word])[0]
        if len(word) <= LONG_WORD:
            self[word] = found
            self.bytes += 200 + 4 * len(word) + len(found or b"")  # entry, word and ids with their headers
        return found


def shard_writer(folder: str, tokenizer_path: str) -> Callable:
    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        encode = WordEncoder(tokenizer_path)
        end = (0).to_bytes(encode.width, "little")
        files, base = filesystem(folder)
        shard = TaskContext.get().partitionId()
        name = f"{base}/part-{shard:07d}.sst"
        writer = None
        for batch in batches:
            for few in shared.slices(batch, 1, DOCS_AT_ONCE, BYTES_AT_ONCE):
                for doc_id, data in zip(few.column(0).to_pylist(), encode(few.column(1).to_pylist()), strict=True):
                    key = key_of(doc_id)
                    if writer is None:
                        files.create_dir(base, recursive=True)
                        part, first = f"{name}.{uuid.uuid4().hex}", key
                        writer = ShardWriter(files.open_output_stream(part), encode.width)
                    writer.add(key, data + end)
        if writer is not None:
            writer.close()
            files.move(part, name)  # a second attempt writes the same bytes
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [name], "docs": pa.array([writer.docs], pa.int64()), "ids": pa.array([writer.ids], pa.int64()), "first_key": [first], "last_key": [key]})

    return run


def write_table(docs: DataFrame, folder: str, tokenizer_path: str, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes ``docs``; returns the manifest: shard, file, docs, ids, first_key, last_key."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(shared.utf8_size(F.col("text")))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, math.ceil(total / shard_bytes))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    return shared.written(ordered.mapInArrow(shard_writer(folder, tokenizer_path), "shard long, file string, docs long, ids long, first_key binary, last_key binary"), "manifest")


def shard_reader(folder: str) -> Callable:
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        files, _ = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                size = files.get_file_info(row["file"]).size
                with files.open_input_file(row["file"]) as f:
                    reader = ShardReader(f, size)
                    kind = "<u2" if reader.width == 2 else "<u4"
                    for b in range(len(reader.blocks)):
                        out = [(id_of(key), row["start"] + before, len(ids) // reader.width, zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())) for key, before, ids in reader.entries(b)]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_table(manifest: DataFrame, folder: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens, ids_crc32, read from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.select("shard", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    spread = placed.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(shard_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def shards_of(manifest: DataFrame, keys: list[bytes]) -> DataFrame:
    """The shards whose ranges hold some of a few keys, by predicates that reach the manifest's Parquet."""
    held = F.lit(False)
    for key in keys:
        held = held | ((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key)))
    return manifest.where(held).orderBy("shard")


def lookup(manifest: DataFrame, folder: str, ids: list[int | None]) -> dict[int | None, list[list[int]]]:
    """Ids of a few documents by key, on the driver: manifest, filter, block index, and the block that may hold it."""
    import numpy as np

    files, _ = filesystem(folder)
    found: dict[int | None, list[list[int]]] = {}
    for row in shards_of(manifest, [key_of(i) for i in ids]).toLocalIterator():
        with files.open_input_file(row["file"]) as f:
            reader = ShardReader(f, files.get_file_info(row["file"]).size)
            for i in ids:
                key = key_of(i)
                hits = reader.get(key) if bytes(row["first_key"]) <= key <= bytes(row["last_key"]) else []
                if hits:
                    found.setdefault(i, []).extend(np.frombuffer(x, "<u2" if reader.width == 2 else "<u4").tolist() for _, x in hits)
    return found


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded, written as shards and read back."""
    import public_tokenizers

    folder = shared.fresh_path(spark, "sstable")
    manifest = write_table(shared.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_table(manifest, folder)
