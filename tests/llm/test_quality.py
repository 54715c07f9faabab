import random
import re
from collections import Counter

from helpers_llm import DOCS, prose, with_clashes

from waypost.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(again)


def labelled(rng, n=300):
    good = [(10_000 + i, prose(rng, 80), "en", "s", 1) for i in range(n)]
    bad = [(20_000 + i, re.sub(r"\bw(\d)", r"W\1$$$", prose(rng, 80)), "en", "s", 1) for i in range(n)]
    return good + bad, [(r[0], int(r[0] < 20_000), 0) for r in good + bad]


def test_contract(spark, rows, folder):
    rng = random.Random(1)
    more, labels = labelled(rng)
    known = [x for x in labels if x[0] % 3] + [(None, 1, 0), (1, None, 0), (77_777, 1, 1)]
    data = rows + more + [(30_000, "x\n x\nx\n\ty\ny\ny " * 9, "en", "s", 1)]
    got = quality.op7_quality(spark, folder(documents=(data, DOCS), labels=(known, LABELS))).collect()
    want = sorted(((r[0] is None, r[0] or 0, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]) for r in data for c in [brute(r[1])]), key=repr)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in got), key=repr) == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    held_out = [r for r in got if r["doc_id"] and 10_000 <= r["doc_id"] < 30_000 and r["doc_id"] % 3 == 0 and not r["base_failed"]]
    right = sum(r["kept"] == (r["doc_id"] < 20_000) for r in held_out)
    assert len(held_out) > 100 and right >= 0.97 * len(held_out)


def test_without_labels_clashes_and_empty(spark, docs, rows):
    none = spark.createDataFrame([], LABELS)
    assert quality.train(docs, none) is None and quality.train(docs.limit(0), none) is None
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS)
    assert quality.train(docs, one_kind) is None
    kept = quality.keep_good(with_clashes(docs), None)
    assert kept.columns == with_clashes(docs).columns
    assert kept.count() == sum(not quality.base_failed(list(brute(r[1]))) for r in rows)
    assert quality.score(docs.limit(0), None).count() == 0


def test_calibration(spark):
    import numpy as np

    z = np.concatenate([np.full(90, 2.0), np.full(10, 2.0), np.full(50, -1.0)])
    y = np.concatenate([np.ones(90), np.zeros(10), np.zeros(50)])
    a, b = quality.platt(z, y)
    assert abs(1 / (1 + np.exp(-(2 * a + b))) - 0.9) < 0.03 and 1 / (1 + np.exp(-(-a + b))) < 0.1


def test_features_dont_depend_on_pieces(monkeypatch, rows):
    """N-grams of words and of characters, of the whole text."""
    import numpy as np

    def brute_counts(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return [max(0, len(words) - n + 1) if unit == "word" else max(0, len(text or "") - n + 1) for unit, n in quality.FAMILIES]

    whole = [quality.shares(r[1]) for r in rows]
    monkeypatch.setattr(quality.H, "PIECE", 50)
    for r, (at, share) in zip(rows[:70] + rows[-14:], whole[:70] + whole[-14:], strict=True):
        again = quality.shares(r[1])
        assert np.array_equal(at, again[0]) and np.allclose(share, again[1])
        n = [0] * 4
        for family, h in quality.measure(r[1])[1]:
            n[family] += len(h)
        assert n == brute_counts(r[1])
        assert abs(share.sum() - sum(k > 0 for k in n)) < 1e-3


def test_verdicts_are_the_logistic_regression(spark, rows, folder):
    """Against a plain reading of the model: each family's mean weight, slope and offset, and a gradient that is small at the weights found."""
    import numpy as np

    more, labels = labelled(random.Random(2), 150)
    docs = spark.createDataFrame(rows + more, DOCS)
    model = quality.train(docs, spark.createDataFrame(labels, LABELS))
    assert model["n_rows"] == 300
    for text in [r[1] for r in more[:5] + more[-5:]]:
        at, share = quality.shares(text)
        z = float(share @ model["weights"][at]) + model["bias"]
        assert abs(quality.judged(model, text)[2] - 1 / (1 + np.exp(-(model["slope"] * z + model["offset"])))) < 1e-4


def test_pairs_of_words_count():
    """Bad texts made of the good ones' words, in another order."""
    import numpy as np

    rng = random.Random(8)
    follows = {f"w{i}": f"w{(7 * i + 3) % 50}" for i in range(50)}

    def text(good):
        out = [f"w{rng.randrange(50)}"]
        while len(out) < 60:
            out.append(follows[out[-1]] if good and rng.random() < 0.8 else f"w{rng.randrange(50)}")
        return " ".join(out)

    texts = [(i % 2, text(i % 2)) for i in range(400)]
    rows = [quality.shares(t) for _, t in texts]
    y = np.array([k for k, _ in texts], float)
    weights, bias = quality.descend(rows[:300], y[:300], 1)
    assert ((quality.margins(rows[300:], weights, bias) > 0) == (y[300:] == 1)).mean() > 0.95
