import random
from collections import defaultdict

import pytest
from helpers_llm import DOCS, prose, with_clashes

from waypost.llm import mixing


def brute_targets(sizes):
    """Shares by weight, the excess over three times a source's size shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed: dict = {}
    total = sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 40, 1000, 100_000]) for s in ["a", "b", "é", "Z", "", "zz", "😀", None, "m1", "m2"]}
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6), (s, sizes)


def big(rng):
    return [(i, prose(rng, int(rng.lognormvariate(4, 1)) + 1), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(2500)]


def test_contract(spark, rows, folder):
    data = big(random.Random(1)) + [(100_000 + i, *r[1:]) for i, r in enumerate(rows)] + [(9, "same row again", "en", "b", 1)] * 300
    at = folder(documents=(data, DOCS))
    got = mixing.op6_mixing(spark, at).collect()
    assert len(got) == len(data)
    size_of = defaultdict(list)
    for r in data:
        size_of[r[0]].append((len([w for w in (r[1] or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]), r[3]))
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, n) for i, v in size_of.items() for n, _ in v)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        source = size_of[r["doc_id"]][0][1] if r["doc_id"] != 9 else None
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        target[key] = r["target"]
        del source
    for v in size_of.values():
        for n, s in v:
            sizes[s] += n
    want = brute_targets(sizes)
    assert sorted(target.values()) == pytest.approx(sorted(want.values()))
    for key, words in taken.items():
        if key[0] not in (sizes["s2"],):  # one document there has nearly all words
            assert abs(words - target[key]) <= max(0.005 * target[key], 10), key
    again = mixing.op6_mixing(spark, at).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_expectations_are_kept(spark):
    """Over seeds, a document of rate p is taken about p of the time, whatever its size."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), "x" if i < 70 else "y") for i in range(100)], "doc_id long, text string, source string")
    hits, runs = defaultdict(int), 12
    for seed in range(runs):
        for r in mixing.mix(docs, weights=(1, 3), seed=seed).collect():
            hits[r["source"], r["size"]] += r["copies"]
            rate = r["target"] / r["source_size"]
            assert r["copies"] in (int(rate), int(rate) + 1)
    for size in range(1, 8):
        assert abs(hits["x", size] / runs / 10 - 0.36) < 0.3


def test_mixed_rows(spark, docs, rows):
    more = with_clashes(docs)
    got = mixing.mixed(more)
    assert got.columns == more.columns
    taken = {(r["id"], r["h1"]): 0 for r in mixing.mix(more).collect()}
    for r in mixing.mix(more).collect():
        taken[r["id"], r["h1"]] += r["copies"]
    assert got.count() == sum(taken.values())
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null")).count() == sum(r[1] is None for r in rows)


def test_repeats_make_no_long_arrays(spark):
    """A row repeated often is one member of the tree, and is unfolded by short arrays."""
    from pyspark.sql import functions as F

    from waypost.llm import shared

    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source")).union(spark.createDataFrame([(i, "w " * (1 + i % 9), "b") for i in range(2, 3000)], "doc_id long, text string, source string"))
    planned = {r["id"]: r for r in mixing.plan(docs).collect()}
    assert len(planned) == 2999 and planned[1]["n"] == 20_000 and planned[1]["whole"] * 20_000 + planned[1]["more"] == pytest.approx(planned[1]["target"] / 3, abs=1)
    got = mixing.mix(docs).groupBy("id").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).where("id = 1").first()
    assert (got["n"], got["copies"]) == (20_000, planned[1]["whole"] * 20_000 + planned[1]["more"])
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 4), ("d", 5), ("e", 64), ("f", 1000)], "x string, n long")
    out = shared.expanded(rows, F.col("n"), 1000, 4).groupBy("x").agg(F.count("*").alias("k"), F.min("nth").alias("low"), F.max("nth").alias("high"), F.count_distinct("nth").alias("d")).collect()
    assert sorted(tuple(r) for r in out) == [(x, n, 1, n, n) for x, n in (("b", 1), ("c", 4), ("d", 5), ("e", 64), ("f", 1000))]


def test_many_sources(spark):
    """As many as rows: they are ranked by ranges, not in one task."""
    sizes = {f"s{i:04d}": (i * 37) % 101 for i in range(900)}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want) and got.keys() == want.keys()
