"""Quality rules: a few counts with fixed limits, and a classifier of word and character n-grams.

The classifier is a logistic regression over hashed frequencies of a text's
words, pairs of words, and runs of three and of five characters, trained on a bounded sample of
labelled rows (at most ``TRAIN_ROWS`` and ``TRAIN_BYTES``, see ``shared.labelled_texts``), with its
probabilities calibrated on a part of the sample held out from training (Platt's method).
Features are hashed and the weights trained on the executors; only the weights reach the driver.
Scores are made in Arrow batches over whole texts, a piece of a long text after the other.

Defined cases: null, empty and blank texts have no words and fail the base
rules; without labels of both kinds the classifier keeps everything; repeated
rows are judged alike; a label that is null doesn't count, contradicting labels of an id
count as the lower; other columns are passed through untouched or not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from . import shared

#: Bounds of the training sample: rows, and bytes of text.
TRAIN_ROWS, TRAIN_BYTES = 4000, 24 << 20
DIMENSIONS = 1 << 18
#: (unit, length) of the n-grams; each family's frequencies add up to one.
FAMILIES = (("word", 1), ("word", 2), ("char", 3), ("char", 5))
DOCS_AT_ONCE, BYTES_AT_ONCE = 500, 4 << 20
#: A text is kept at this calibrated probability of being good, or more.
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(words, raw: bytes, text: str) -> Iterator:
    import numpy as np

    shift = np.uint64(64 - (DIMENSIONS.bit_length() - 1))
    points = H.code_points(raw, text)
    for family, (unit, n) in enumerate(FAMILIES):
        for h in [H.windows(words, n)] if unit == "word" else H.char_grams(points, n):
            yield family, (H.mixed(h + np.uint64(family)) >> shift).astype(np.int32)


def measure(text: str | None) -> tuple[list[int], Iterator]:
    """The counts of a text, and its features: (family, numbers) of a piece after the other."""
    import numpy as np

    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    inside = ~H.BLANK[data]
    starts, ends = H.runs(inside)
    words = H.word_hashes(data, starts, ends)
    symbols = np.zeros(256, np.int64)
    symbols[list(SYMBOLS.encode())] = 1
    again = 0
    if len(words) > REPEAT_WINDOW:
        w = H.windows(words, REPEAT_WINDOW)
        ordered = np.sort(w)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(w, twice))
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + REPEAT_WINDOW, -1)
            again = int((np.cumsum(cover) > 0).sum())
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated_lines += 1
        elif line.strip():
            seen.add(line)
    counts = [len(words), int((inside & (data & 0xC0 != 0x80)).sum()), int(symbols[data].sum()), repeated_lines, again]
    return counts, features(words, raw, text or "")


def base_failed(counts: list[int]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED_PERCENT * counts[0]


def shares(text: str | None):
    """Numbers and frequencies of a text's features."""
    import numpy as np

    parts, n = [], [0] * len(FAMILIES)
    for family, h in measure(text)[1]:
        parts.append((family, *np.unique(h, return_counts=True)))
        n[family] += len(h)
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, which = np.unique(np.concatenate([at for _, at, _ in parts]), return_inverse=True)
    share = np.bincount(which, weights=np.concatenate([k / max(1, n[family]) for family, _, k in parts]))
    return at, share.astype(np.float32)


def hashed(batches):
    """(h, id, y, text) to (h, id, y, features): numbers and frequencies, as bytes."""
    import pyarrow as pa

    for batch in batches:
        for part in shared.slices(batch, 3, DOCS_AT_ONCE, BYTES_AT_ONCE):
            found = [at.tobytes() + share.tobytes() for at, share in map(shares, part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.binary())], ["h", "id", "y", "features"])


def margins(rows: list, weights, bias: float):
    """Scores of some sparse rows (numbers, frequencies)."""
    import numpy as np

    return np.array([float(share @ weights[at]) for at, share in rows]) + bias


def descend(rows: list, y, seed: int, epochs: int = 12, at_once: int = 200, rate: float = 0.3, l2: float = 1e-5):
    """Logistic regression on sparse rows by accelerated gradients of small groups; the weights of the second half are averaged."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    weights, mean = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    t = n_mean = 0
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(rows)), -(-len(rows) // at_once)):
            part = [rows[i] for i in some]
            g = (1 / (1 + np.exp(-np.clip(margins(part, weights[:-1], weights[-1]), -30, 30))) - y[some]) / len(some)
            at, share = (np.concatenate([r[k] for r in part]) for k in (0, 1))
            grad = np.append(np.bincount(at, weights=share * np.repeat(g, [len(r[0]) for r in part]), minlength=DIMENSIONS), g.sum())
            grad[:-1] += l2 * weights[:-1]
            t += 1
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            if 2 * epoch >= epochs:
                mean += weights
                n_mean += 1
    mean /= n_mean
    return mean[:-1].astype(np.float32), float(mean[-1])


def platt(z, y) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities; counts of both kinds are smoothed."""
    import numpy as np

    good, bad = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - goal) * z).sum() + 1e-3 * a, (p - goal).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(a), float(b)


def trainer(seed: int) -> Callable:
    """Batches of (.., y, features) to the model, or None."""

    def fit(batches):
        import numpy as np

        rows, y = [], []
        for batch in batches:
            for label, cell in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = cell.as_buffer()  # not copied
                if found.size:
                    rows.append((np.frombuffer(found, np.int32, found.size // 8), np.frombuffer(found, np.float32, found.size // 8, found.size // 2)))
                    y.append(float(label))
        labels = np.array(y)
        chosen = np.random.Generator(np.random.PCG64(seed)).random(len(labels)) < 0.75
        if len(labels) < 20 or not 0 < labels[chosen].sum() < chosen.sum() or not 0 < labels[~chosen].sum() < (~chosen).sum():
            return None
        weights, bias = descend([r for r, c in zip(rows, chosen, strict=True) if c], labels[chosen], seed)
        slope, offset = platt(margins([r for r, c in zip(rows, chosen, strict=True) if not c], weights, bias), labels[~chosen])
        return {"weights": weights, "bias": bias, "slope": slope, "offset": offset, "n_rows": len(labels)}

    return fit


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, seed: int = 41, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The classifier: weights, bias, slope, offset; None without both kinds of labels."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("y"))
    sample = shared.labelled_texts(docs, known, rows, size, seed, id_col, text_col).select("h", "id", "y", "text")
    kind = sample.schema["id"].dataType.simpleString()
    return shared.fitted(sample.mapInArrow(hashed, f"h long, id {kind}, y int, features binary"), trainer(seed), "h", "id")


def judged(model: dict | None, text: str | None) -> tuple[list[int], bool, float]:
    """Counts, whether the base rules fail, and the probability of being good."""
    import math

    counts, families = measure(text)
    p = 1.0
    if model is not None:
        sums, n = [0.0] * len(FAMILIES), [0] * len(FAMILIES)
        for family, h in families:
            sums[family] += float(model["weights"][h].sum(dtype="float64"))
            n[family] += len(h)
        z = model["bias"] + sum(x / max(1, k) for x, k in zip(sums, n, strict=True))
        p = 1 / (1 + math.exp(-max(-60.0, min(60.0, model["slope"] * z + model["offset"]))))
    return counts, base_failed(counts), p


def scorer(model: dict | None) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shared.slices(batch, 1, DOCS_AT_ONCE, BYTES_AT_ONCE):
                out = [judged(model, t) for t in part.column(1).to_pylist()]
                counts = zip(*(o[0] for o in out), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.float64()), pa.array([not o[1] and o[2] >= KEEP_AT for o in out], pa.bool_())],
                    [part.schema.names[0], *COUNTS, "base_failed", "p_good", "kept"],
                )

    return run


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, the counts, base_failed, p_good, kept."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(scorer(model), f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, p_good double, kept boolean")


def keep_good(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shared.slices(batch, at, DOCS_AT_ONCE, BYTES_AT_ONCE):
                verdicts = (judged(model, t) for t in part.column(at).to_pylist())
                yield part.filter(pa.array([not failed and p >= KEEP_AT for _, failed, p in verdicts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the classifier's verdict on all ``documents``."""
    docs = shared.table(spark, sf_dir, "documents")
    return score(docs, train(docs, shared.table(spark, sf_dir, "labels"))).drop("p_good")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op7 on all ``documents``, without the classifier."""
    return score(shared.table(spark, sf_dir, "documents"), None).drop("p_good", "kept")


BASE_ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + {REPEAT_WINDOW - 1}], ' ') AS g FROM d, LATERAL unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) AS r(i)),
twice AS (SELECT doc_id, g FROM runs GROUP BY doc_id, g HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + {REPEAT_WINDOW})) AS k FROM runs JOIN twice USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counted
"""
