import random
import zlib

import numpy as np
import public_tokenizers
from helpers_llm import DOCS, prose, with_clashes
from tokenizers import Tokenizer

from waypost.llm import sstable

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", "a  b", "a \n b", "a b ", "\ta\t b", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|> b", "it's  don't we'll, ok?", "é  b c d", "a\x1c b\x85 c", "\n\n a", "a​ b 12 3,4", "ñandú 😀 x", "Ünï, ß. œ", "a b c", "word, word. word; 5th", "ǅ ŉx ĸ ŉ"]


def test_word_encoder_is_the_tokenizer():
    tok, enc = Tokenizer.from_file(PATH), sstable.WordEncoder(PATH)
    rng = random.Random(3)
    alphabet = "ab cé,.'\n\t 1<|> ßŉ—😀Z"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [prose(rng, 300)]
    for part in (texts, texts[::-1]):
        for text, got in zip(part, enc(part), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_contract(spark, rows, folder):
    tok = Tokenizer.from_file(PATH)
    got = sstable.op4_sstable(spark, folder(documents=(rows, DOCS))).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((r[0] is not None, r[0] or 0, len(e) + 1, zlib.crc32(np.array([*e, 0], "<u4").tobytes())) for r in rows for e in [tok.encode(r[1] or "", add_special_tokens=False).ids])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_lookup_over_many_shards(spark, docs, rows, tmp_path):
    tok, folder = Tokenizer.from_file(PATH), str(tmp_path / "t")
    manifest = sstable.write_table(with_clashes(docs), f"file://{folder}", PATH, shard_bytes=20_000)
    assert manifest.count() > 5
    found = sstable.lookup(manifest, f"file://{folder}", [5, 103, None, 9999])
    encoded = lambda i: sorted([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows if r[0] == i)
    for i in (5, 103, None):
        assert sorted(found[i]) == encoded(i)
    assert 9999 not in found


def test_lookup_opens_only_what_may_hold_the_key(spark, docs, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    manifest = sstable.write_table(docs, folder, PATH, shard_bytes=20_000)
    ranges = [(bytes(r["first_key"]), bytes(r["last_key"])) for r in manifest.orderBy("shard").collect()]
    assert len(ranges) > 5 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    opened, real = [], sstable.ShardReader
    monkeypatch.setattr(sstable, "ShardReader", lambda f, size: opened.append(size) or real(f, size))
    for i in (42, None, 9999):
        opened.clear()
        sstable.lookup(manifest, folder, [i])
        assert len(opened) == sum(a <= sstable.key_of(i) <= b for a, b in ranges) <= 2


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(sstable, "MEMORY_BYTES", 20_000)
    enc, tok = sstable.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for i in range(30):
        texts = [" ".join(f"word{i}x{j}" for j in range(40)), "y" * 5000 + str(i), "z" * 300]
        for text, got in zip(texts, enc(texts), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids
        assert enc.memory.bytes < 60_000 and max(map(len, [*enc.memory, *enc.first])) <= sstable.LONG_WORD


def test_file_format(tmp_path):
    blocks = sstable.BLOCK_BYTES
    sstable.BLOCK_BYTES = 300
    try:
        out = open(tmp_path / "f", "wb")
        writer = sstable.ShardWriter(out, 2)
        keys = [None, -5, -5, 0, 1, 255, 256, 65536, 1 << 40]
        data = {i: np.arange(i * 20, dtype="<u2").tobytes() for i in range(len(keys))}
        for i, k in enumerate(keys):
            writer.add(sstable.key_of(k), data[i])
        writer.close()
    finally:
        sstable.BLOCK_BYTES = blocks
    with open(tmp_path / "f", "rb") as f:
        reader = sstable.ShardReader(f, (tmp_path / "f").stat().st_size)
        assert len(reader.blocks) > 2 and reader.docs == len(keys)
        every = [(sstable.id_of(k), before, bytes(ids)) for b in range(len(reader.blocks)) for k, before, ids in reader.entries(b)]
        assert every == [(k, sum(len(data[j]) // 2 for j in range(i)), data[i]) for i, k in enumerate(keys)]
        assert len(reader.get(sstable.key_of(-5))) == 2 and reader.get(sstable.key_of(77)) == []
        raw = bytearray((tmp_path / "f").read_bytes())
    raw[20] ^= 1
    (tmp_path / "g").write_bytes(raw)
    with open(tmp_path / "g", "rb") as f:
        damaged = sstable.ShardReader(f, len(raw))
        try:
            list(damaged.entries(0))
            raise AssertionError
        except ValueError:
            pass


def test_empty(spark, docs, tmp_path):
    manifest = sstable.write_table(docs.limit(0), f"file://{tmp_path}/e", PATH)
    assert manifest.count() == 0 and sstable.read_table(manifest, f"file://{tmp_path}/e").count() == 0
