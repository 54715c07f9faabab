import random
import zlib
from itertools import product

import numpy as np
import pytest
from helpers_llm import DOCS, prose, with_clashes

from waypost.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def brute_marginals(emission, sizes, moves):
    out, at = [], 0
    for n in sizes:
        e = emission[at : at + n]
        at += n
        total, ones = 0.0, np.zeros(n)
        for states in product((0, 1), repeat=int(n)):
            w = np.exp(sum(x for x, s in zip(e, states, strict=True) if s) + (moves[4] if states and states[0] else 0) + sum(moves[2 * a + b] for a, b in zip(states, states[1:], strict=False)))
            total, ones = total + w, ones + w * np.array(states)
        out += list(ones / total) if n else []
    return out


@pytest.mark.parametrize("seed", range(5))
def test_forward_backward(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 7, 12)
    emission, moves = rng.normal(size=sizes.sum()) * 2, rng.normal(size=5)
    assert np.allclose(toxicity.marginals(emission, sizes, moves)[0], brute_marginals(emission, sizes, moves))


def test_gradient():
    """The field's likelihood rises to where expected and seen counts agree."""
    rng = np.random.default_rng(1)
    sizes = np.full(200, 12)
    label = rng.random(2400) < 0.2
    features = np.where(label, rng.integers(1, 6, 2400), rng.integers(5, 60, 2400))[None, :]
    weights, moves, bias = toxicity.fit_field([(features, np.arange(2400), sizes, label)], rounds=200, l2=1e-3)
    p = toxicity.marginals(weights[features].sum(axis=0) + bias, sizes, moves)[0]
    assert abs(p.sum() - label.sum()) < 0.05 * label.sum() and p[label].mean() > 0.8


def corpus(rng, n=900):
    docs, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.randint(20, 90)).split(), i % 6 == 0
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["vilest", "vilefoo!", "Vilebar", "wretched", "wretch,"])
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_contract(spark, rows, folder):
    data, labels = corpus(random.Random(3))
    odd = [(5_000 + i, *r[1:]) for i, r in enumerate(rows)] + [(None, "vilest wretched vilefoo vilebar x", "en", "s", 1)]
    got = toxicity.op8_toxicity(spark, folder(documents=(data + odd, DOCS), labels=([*labels, (None, 1, 1), (6, 1, None)], LABELS))).collect()
    assert len(got) == len(data) + len(odd)
    truth = {r[0]: r[2] for r in labels}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    unseen = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in unseen) >= 0.97 * len(unseen)
    texts = {r[0]: r[1] for r in data}
    found = [texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in unseen for s in r["spans"]]
    assert found and sum(any(w in f for w in ("vile", "wretch")) for f in found) >= 0.95 * len(found)


def test_held_out_labels_dont_count(spark, folder):
    data, labels = corpus(random.Random(3), 400)
    docs = spark.createDataFrame(data, DOCS)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert np.array_equal(a["weights"], b["weights"]) and np.array_equal(a["calibration"], b["calibration"])


def test_no_labels_clashes_and_empty(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.train(docs, none) is None and toxicity.train(docs.limit(0), none) is None
    got = toxicity.score(with_clashes(docs), None)
    assert got.where("score = 0").count() == docs.count() and toxicity.score(docs.limit(0), None).count() == 0


def test_all_clean_rows_train_the_field(spark):
    """Not only those of the lowest ids, nor only short ones."""
    rng = random.Random(12)
    toxic = [(i, prose(rng, 20) + " vile" + str(i % 3)) for i in range(0, 60)]
    clean = [(1000 + i, prose(rng, 20)) for i in range(150)] + [(5000 + i, " ".join(f"ñandu{rng.randrange(90)}" for _ in range(20))) for i in range(150)]
    long = [(9000, prose(rng, 60_000)), (9002, prose(rng, 90_000) + " vile1")]
    docs = spark.createDataFrame(toxic + clean + long, "doc_id long, text string").coalesce(2)
    labels = spark.createDataFrame([(i, int(i < 1000 or i == 9002)) for i, _ in toxic + clean + long], "doc_id long, toxic int").coalesce(2)
    free = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in toxic + clean + long)
    model = toxicity.train(docs, labels)
    assert model["n_docs"] == free
    fold = np.random.Generator(np.random.PCG64(53)).integers(0, toxicity.FOLDS, free)
    assert model["n_fit"] == (fold != 0).sum()
    assert toxicity.train(docs, labels, rows=100)["n_docs"] == 100


def test_sample_is_bounded_by_bytes_and_one_text(spark):
    from waypost.llm import shared

    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string")
    known = docs.selectExpr("doc_id AS id", "1 AS y")
    sample = lambda size: {r["id"] for r in shared.labelled_texts(docs, known, 40, size, 7, "doc_id", "text").collect()}
    assert len(sample(10**6)) == 40 and len(sample(950)) == 10 and len(sample(1)) == 1 and sample(950) < sample(10**6)


def test_long_documents_are_several_chains(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = np.array([0, 5, 40, 16, 0, 17])
    emission, moves = rng.normal(size=sizes.sum()), rng.normal(size=5)
    monkeypatch.setattr(toxicity, "CHAIN", 8)
    assert toxicity.chains(sizes).tolist() == [0, 5, 8, 8, 8, 8, 8, 8, 8, 0, 8, 8, 1]
    want = toxicity.marginals(emission, toxicity.chains(sizes), moves)[0]
    for at_once in (1, 20, 1000):
        monkeypatch.setattr(toxicity, "SCAN", at_once)
        assert np.allclose(toxicity.probabilities(emission, sizes, moves), want)


def test_features_dont_depend_on_pieces(monkeypatch):
    rng = random.Random(4)
    text = prose(rng, 300) + " ñandú " + "x" * 200
    whole = toxicity.all_features(text)
    monkeypatch.setattr(toxicity.H, "PIECE", 64)
    assert np.array_equal(toxicity.all_features(text), whole) and whole.shape == (6, 302)
