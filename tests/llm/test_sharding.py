import zlib
from collections import Counter, defaultdict

from helpers_llm import DOCS, with_clashes
from pyspark.sql import functions as F

from waypost.llm import shared, sharding



def test_contract(spark, rows, folder):
    got = sharding.op1_sharding(spark, folder(documents=(rows, DOCS))).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "key" and 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in got:
        assert {x["shard"] for x in got if x["doc_id"] == r["doc_id"]} == {r["shard"]}


def test_many_buckets_reruns_and_shuffles(spark, tmp_path):
    docs = spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    order = []
    for name in ("a", "b"):
        path = str(tmp_path / name)
        sharding.write_shards(docs, path, bucket_bytes=2000)
        order.append([(r["doc_id"], r["shard"], r["slot"]) for r in sharding.read_shards(spark, path, docs.schema).orderBy("shard", "slot").collect()])
    assert order[0] == order[1] and len(order[0]) == 3000
    first = [d for d, s, _ in order[0] if s == 0]
    assert sum(a < b for a, b in zip(first, first[1:], strict=False)) < 0.65 * len(first)
    assert max(Counter(s for _, s, _ in order[0]).values()) < 1.3 * 3000 / 8


def test_one_row_repeated_is_spread(spark, tmp_path):
    docs = spark.range(0, 4000, 1, 40).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(docs, str(tmp_path / "x"), bucket_bytes=4000)
    per = spark.read.parquet(str(tmp_path / "x")).groupBy("bucket").count().collect()
    assert len(per) > 10 and sum(r["count"] for r in per) == 4000


def test_clashes_and_empty(spark, docs, tmp_path):
    more = with_clashes(docs)
    sharding.write_shards(more, str(tmp_path / "c"))
    got = sharding.read_shards(spark, str(tmp_path / "c"), more.schema)
    assert got.count() == docs.count() and got.where("size = 'own size' AND slot >= 0").count() == docs.count()
    sharding.write_shards(docs.limit(0), str(tmp_path / "e"))
    assert sharding.read_shards(spark, str(tmp_path / "e"), docs.schema).count() == 0
    assert shared.shared_dir(spark)
