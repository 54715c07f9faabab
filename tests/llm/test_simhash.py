import random
from itertools import combinations

import pytest
import xxhash
from helpers_llm import DOCS, prose, with_clashes

from waypost.llm import components, simhash

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, k):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(TO_LOWER)).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


def near_texts(rng):
    """Groups of texts that differ in a word or two."""
    out = []
    for _ in range(6):
        base = prose(rng, 250).split()
        for _ in range(4):
            words = list(base)
            words[rng.randrange(250)] = "changed"
            out.append(" ".join(words))
    return out


def test_contract(spark, rows, folder):
    rng = random.Random(2)
    data = rows + [(500 + i, t, "en", "s0", 1) for i, t in enumerate(near_texts(rng))]
    got = simhash.op2_simhash(spark, folder(documents=(data, DOCS))).collect()
    assert len(got) == len(data)
    fps = [brute_fingerprint(r[1], 4) for r in data]
    roots = brute_components(fps, 4)
    least = {}
    for r, f in zip(data, fps, strict=True):
        if r[0] is not None:
            least[roots[f]] = min(least.get(roots[f], r[0]), r[0])
    want = sorted(((r[0] is None, r[0] or 0, f"{f:016x}", least.get(roots[f])) for r, f in zip(data, fps, strict=True)), key=repr)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got), key=repr) == want
    assert any(r["component_id"] != r["doc_id"] and r["doc_id"] and r["doc_id"] >= 500 for r in got)


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_difference(radius):
    rng = random.Random(4)
    masks = simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, radius)):
            y ^= 1 << b
        assert any((x ^ y) & m == 0 for m in masks)


@pytest.mark.parametrize("task_bucket", [1, 5, 4096])
def test_small_and_large_buckets_link_alike(spark, task_bucket):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    for _ in range(120):  # one dense group
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, task_bucket)
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute_components({f for f in fps}, 4)
    groups = lambda of: {frozenset(f for f in of if of[f] == r) for r in set(of.values())}
    assert groups({f % (1 << 64): roots.get(f, f) % (1 << 64) for f in signed}) == groups(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100} | {1000 + i: 1000 for i in range(1, 50)}


def test_clashing_columns_and_empty(spark, docs):
    told = lambda df: sorted(map(repr, simhash.near_duplicates(df).collect()))
    assert told(with_clashes(docs).drop("fp", "label")) == told(docs)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
