import random
import re
from itertools import combinations

import pytest
from helpers_llm import DOCS, prose, with_clashes

from waypost.llm import neardup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts):
    """A root for every text, from the exact similarity of all pairs."""
    of = {t: shingles(t) for t in texts}
    root = {s: s for s in of.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(list(root), 2):
        if a and b and len(a & b) >= 0.8 * len(a | b) and find(a) != find(b):
            root[find(b)] = find(a)
    return {t: find(s) for t, s in of.items()}


def copies(rng, n=12):
    """Texts with edits of a few words, and others."""
    out = []
    for _ in range(n):
        base = prose(rng, 200, 5000).split()
        for edits in (0, 1, 2, 3):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(200)] = f"changed{rng.randrange(1000)}"
            out.append(" ".join(words))
        out.append(" ".join(rng.sample(base, 200)))  # the same words in another order
    return out


@pytest.mark.parametrize("task_bucket", [2, 500])
def test_as_brute_force(spark, rows, task_bucket):
    data = [r for r in rows if r[1] != ""] + [(700 + i, t, "en", "s", 1) for i, t in enumerate(copies(random.Random(3)))]
    docs = with_clashes(spark.createDataFrame(data, DOCS))
    got = neardup.one_of_each(docs, task_bucket=task_bucket)
    assert got.columns == docs.columns
    roots, first = brute_groups([r[1] for r in data]), {}
    for r in sorted(set(data), key=lambda r: (r[0] is not None, r[0] or 0)):
        first.setdefault(roots[r[1]], []).append(r)
    kept = got.collect()
    assert len(kept) == len(first)
    lowest = {root: members[0][0] for root, members in first.items()}
    assert {(roots[r["text"]], r["doc_id"]) for r in kept} == set(lowest.items())


def test_similar_go_and_others_stay(spark):
    texts = copies(random.Random(4), 30)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in neardup.one_of_each(docs).collect()}
    assert all(i in kept for i in range(150) if i % 5 == 4), "the same words in another order are another text"
    assert all(i in kept for i in range(150) if i % 5 == 0)
    assert sum(i in kept for i in range(150) if i % 5 in (1, 2, 3)) <= 3


def test_empty(spark, docs):
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def edits(rng, size):
    """A text and what block edits and scattered ones make of it, by kind."""
    base = prose(rng, size, 5000).split()
    fresh = lambda n: prose(rng, n, 5000).split()
    k, at = size * 8 // 100, size // 3
    few = list(base)
    for i in rng.sample(range(size), size // 60):
        few[i] = "changed"
    return {"base": base, "more": base + fresh(size * 22 // 100), "some more": base + fresh(size * 12 // 100), "cut": base[size // 6 :], "replaced": base[:at] + fresh(k) + base[at + k :], "scattered": few, "other": base[: size // 2] + fresh(size // 2)}


def jaccard(a, b):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_edits_of_every_kind(spark):
    rng = random.Random(8)
    made = [edits(rng, size) for size in (100, 300, 1000) for _ in range(12)]
    docs, near = [], set()
    for i, kinds in enumerate(made):
        for j, words in enumerate(list(kinds.values())[1:]):
            docs += [(100 * i + 10 * j, " ".join(kinds["base"]) + f" {i} {j}"), (100 * i + 10 * j + 1, " ".join(words) + f" {i} {j}")]
    # each pair alone: the base's copies would link all else
    for j, kind in enumerate(list(made[0])[1:]):
        pairs = [(d, e) for d, e in zip(docs[::2], docs[1::2], strict=True) if d[0] % 100 == 10 * j]
        kept = {r["doc_id"] for r in neardup.one_of_each(spark.createDataFrame([x for p in pairs for x in p], "doc_id long, text string").coalesce(2)).collect()}
        for d, e in pairs:
            assert d[0] in kept and (e[0] not in kept) == (jaccard(d[1].split(), e[1].split()) >= 0.8), (kind, d[0])
        near |= {kind for d, e in pairs if jaccard(d[1].split(), e[1].split()) >= 0.8}
    assert near >= {"more", "some more", "cut", "replaced", "scattered"}


@pytest.mark.parametrize("limits", [{"task_bucket": 3}, {"block_shingles": 250}, {}])
def test_families_as_all_pairs(spark, limits):
    """Similarities around the limit, where many candidates are none: groups are those of the exact similarity."""
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = prose(rng, 120, 5000).split()
        for n in range(14):
            words = list(base)
            for i in rng.sample(range(120), n % 7):
                words[i] = f"x{rng.randrange(10_000)}"
            texts.append(words)
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
            root = [root[i] if r == root[j] else r for r in root]
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    assert {r["doc_id"] for r in neardup.one_of_each(docs, **limits).collect()} == set(first.values())


def test_covering_fingerprints_alone(spark):
    """Without MinHash keys: groups of exactly the similar pairs whose fingerprints differ in 4 or fewer bits."""
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        base = prose(rng, 400, 5000).split()
        for n in (0, 1, 1, 2, 3, 5, 8):
            words = list(base)
            for i in rng.sample(range(400), n):
                words[i] = f"x{rng.randrange(10_000)}"
            texts.append(words)
    texts = [" ".join(t) for t in texts] + ["", "two words", "Two  WORDS"]
    bits = []
    for t in texts:
        hashes = [int(h) for h in neardup.shingle_set(t)]
        bits.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    sets, root, apart = [shingles(t) for t in texts], list(range(len(texts))), 0
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            if (bits[i] ^ bits[j]).bit_count() > 4:
                apart += 1
            elif root[i] != root[j]:
                root = [root[i] if r == root[j] else r for r in root]
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    kept = lambda **how: {r["doc_id"] for r in neardup.one_of_each(docs, **how).collect()}
    alone = kept(n_bands=0)
    # the tables meet some pairs beyond the radius, too, but lose none within it
    assert apart and alone <= set(first.values()) and len(alone) < 100
    assert kept() <= alone and kept(n_bands=0, task_bucket=3) == alone
