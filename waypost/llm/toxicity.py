"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens carry two states.  Labels exist for documents only, so the tokens of a bounded
sample of labelled documents (at most ``TRAIN_ROWS`` and ``TRAIN_BYTES``, see ``shared.labelled_texts``) are labelled first: a token of a
toxic document is toxic if its word, or a beginning of it, occurs in far
more toxic documents than its share.  How far, ``LIMITS``, is settled by cross-validation on the
sample.  The field is trained on these
by the gradient of its likelihood.  Forward and backward passes give every
token's marginal probability; neighbouring tokens over one half form the
offending spans, and the marginals of a document add up to its score, calibrated on
labelled documents that the field hadn't seen by then; a few last rounds train it on these, too.
Features are hashed and the field is trained on the executors.

Both passes work on the ratio of the two states, a fraction of linear terms in its
predecessor, so a batch of documents is scanned as one sequence cut into many
columns that advance together, and cost doesn't depend on how lengths mix.  A chain
has at most ``CHAIN`` tokens; a longer document is several chains, all of them scored.

Defined cases: null and empty texts have no tokens and get the score of a
document without toxic ones; without labels of both kinds all scores are 0;
a null label doesn't count, nor a label without an id, contradicting labels count as toxic; a null id isn't held out;
repeated rows are scored alike; other columns are not looked at; an empty table gives no rows.
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
BEGINNINGS = (3, 4, 5, 6, 7)
FAMILIES = 1 + len(BEGINNINGS)
PREDICT_AT = 0.7
#: Log likelihoods that a word must gain from being tied to toxic documents, of which one is chosen; where toxic documents are a tenth, each that has the word adds 2.3.
LIMITS = (4.5, 6.75, 9.0, 13.5, 20.0)
FOLDS = 4
DOCS_AT_ONCE, BYTES_AT_ONCE = 500, 4 << 20
CHAIN = 1 << 16
#: Tokens that are scanned at once.
SCAN = 1 << 19


def places(text: str | None):
    """Lower-cased bytes of a text, starts and ends of its tokens."""
    import numpy as np

    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    letter = np.ones(256, bool)
    letter[[*range(48), *range(58, 97), *range(123, 128)]] = False
    data = np.frombuffer((text or "").encode().translate(lower), np.uint8)
    return data, *H.runs(letter[data])


def features_of(data, starts, ends) -> Iterator:
    """Feature numbers of the tokens, a piece of the text after the other: a row for the word and each of its beginnings, 0 where it is shorter."""
    import numpy as np

    shift = np.uint64(64 - (DIMENSIONS.bit_length() - 1))
    for i, j, at, prefixes in H.word_pieces(data, starts, ends):
        a, b = starts[i:j] - at, ends[i:j] - at
        out = np.zeros((FAMILIES, j - i), np.int32)
        out[0] = prefixes.of(a, b) >> shift
        for row, k in zip(out[1:], BEGINNINGS, strict=True):
            h = H.mixed(prefixes.of(a, np.minimum(a + k, b)) + np.uint64(k)) >> shift
            row[:] = np.where(b - a >= k, h.astype(np.int32), 0)
        yield out


def all_features(text: str | None):
    import numpy as np

    return np.concatenate([np.zeros((FAMILIES, 0), np.int32), *features_of(*places(text))], axis=1)


def emissions(text: str | None, weights, bias: float):
    """Starts, ends and emissions of a text's tokens."""
    import numpy as np

    data, starts, ends = places(text)
    out = np.full(len(starts), bias)
    at = 0
    for f in features_of(data, starts, ends):
        for row in f:
            out[at : at + f.shape[1]] += weights[row]
        at += f.shape[1]
    return starts, ends, out


def scan(e, c, d, f, g):
    """All v[i] = e[i] * (c[i] + d[i] * v[i-1]) / (f[i] + g[i] * v[i-1]), from v[-1] = 1."""
    import numpy as np

    n = len(e)
    rows = max(1, int(np.sqrt(n) / 6))
    columns = -(-n // rows)
    pad = rows * columns - n
    e, c, d, f, g = (np.concatenate([x, np.ones(pad)]).reshape(columns, rows).T.copy() for x in (e, c, d, f, g))
    p, q, s, t = np.ones(columns), np.zeros(columns), np.zeros(columns), np.ones(columns)  # v -> (p v + q) / (s v + t)
    for i in range(rows):
        p, q, s, t = e[i] * (d[i] * p + c[i] * s), e[i] * (d[i] * q + c[i] * t), g[i] * p + f[i] * s, g[i] * q + f[i] * t
        size = p + q + s + t
        p, q, s, t = p / size, q / size, s / size, t / size
    first = np.empty(columns)
    v = 1.0
    for k, (a, b, x, y) in enumerate(zip(p.tolist(), q.tolist(), s.tolist(), t.tolist(), strict=True)):
        first[k] = v
        v = (a * v + b) / (x * v + y)
    out = np.empty((rows, columns))
    v = first
    for i in range(rows):
        v = out[i] = e[i] * (c[i] + d[i] * v) / (f[i] + g[i] * v)
    return out.T.reshape(-1)[:n]


def marginals(emission, sizes, moves):
    """Probability of state 1 of each token, and the ratios of both passes; ``moves``: logs of staying in 0, 0 to 1, 1 to 0, staying in 1, and starting in 1."""
    import numpy as np

    n = len(emission)
    begin = np.zeros(n + 1, bool)
    begin[np.cumsum(sizes[sizes > 0])[:-1] if n else []] = True
    begin[[0, n]] = True
    m00, m01, m10, m11, start = np.exp(np.clip(moves, -20, 20))
    a00, a10 = np.where(begin, 1.0, m00), np.where(begin, 1.0, m10)
    a01, a11 = np.where(begin, start, m01), np.where(begin, start, m11)
    e = np.exp(np.clip(emission, -30, 30))
    r = scan(e, a01[:-1], a11[:-1], a00[:-1], a10[:-1])
    y = scan(e[::-1], a10[:0:-1], a11[:0:-1], a00[:0:-1], a01[:0:-1])[::-1]  # e * ratio of the backward pass
    odds = r * y / e
    return odds / (1 + odds), r, y, begin


def chains(sizes):
    """Sizes of the chains of documents of some sizes."""
    import numpy as np

    pieces = np.maximum(-(-sizes // CHAIN), 1)
    out = np.full(pieces.sum(), CHAIN, np.int64)
    out[np.cumsum(pieces) - 1] = sizes - (pieces - 1) * CHAIN
    return out


def probabilities(emission, sizes, moves):
    """Probability of being toxic of each token, so many chains at a time that few arrays of their length are held."""
    import numpy as np

    parts = chains(sizes)
    to = np.cumsum(parts)
    out, i = np.empty(len(emission)), 0
    while i < len(parts):
        before = to[i] - parts[i]
        j = max(i + 1, int(np.searchsorted(to, before + SCAN, side="right")))
        out[before : to[j - 1]] = marginals(emission[before : to[j - 1]], parts[i:j], moves)[0]
        i = j
    return out


class Counted:
    """In how many toxic and other documents each feature occurs."""

    def __init__(self):
        import numpy as np

        self.n = np.zeros((2, DIMENSIONS), np.int32)
        self.docs = np.zeros(2, np.int64)

    def add(self, features, toxic: bool) -> None:
        import numpy as np

        self.n[int(toxic), np.unique(features)] += 1
        self.docs[int(toxic)] += 1

    def gains(self):
        """Log likelihood that each feature gains from being tied to toxic documents; 0 where it is not or less so."""
        import numpy as np

        b, a = self.n.astype(np.float64)
        share = self.docs[1] / max(1, self.docs.sum())
        n = np.maximum(a + b, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = a * np.log(np.maximum(a, 0.5) / (share * n)) + b * np.log(np.maximum(b, 0.5) / ((1 - share) * n))
        gain[~(b <= 0.25 * a)] = 0
        gain[0] = 0
        return gain


def chosen_limit(docs: list, fold) -> float | None:
    """The limit whose marks, found on the other folds, tell most about the labels of each; None if none tells anything."""
    import numpy as np

    tables = np.zeros((len(LIMITS), 2, 2))
    for k in range(FOLDS):
        counted = Counted()
        for (toxic, features), at in zip(docs, fold, strict=True):
            if at != k:
                counted.add(features, toxic)
        gains = counted.gains()
        for (toxic, features), at in zip(docs, fold, strict=True):
            if at == k:
                best = gains[features].max() if features.size else 0.0
                for i, limit in enumerate(LIMITS):
                    tables[i, int(toxic), int(best >= limit)] += 1
    told = []
    for t in tables:
        expected = t.sum(axis=1, keepdims=True) * t.sum(axis=0, keepdims=True) / t.sum()
        told.append((t * np.log(np.maximum(t, 1e-9) / np.maximum(expected, 1e-9))).sum() if t[1, 1] > expected[1, 1] else 0.0)
    return LIMITS[int(np.argmax(told))] if max(told) > 0 else None


def marked(features, toxic: bool, marks):
    """Which tokens of a document are labelled toxic."""
    import numpy as np

    return marks[features].any(axis=0) if toxic else np.zeros(features.shape[1], bool)


def blocks(docs: list, marks) -> list:
    """(features, word, sizes, labels) of some documents, about ``SCAN`` tokens at a time; features of distinct words, and each token's word."""
    import numpy as np

    out, held, n = [], [], 0
    weights = H.row_of_powers(FAMILIES + 1)[0][1:, None]
    for i, (toxic, features) in enumerate(docs):
        held.append((features, marked(features, toxic, marks)))
        n += features.shape[1]
        if n >= SCAN or i == len(docs) - 1:
            sizes = chains(np.array([f.shape[1] for f, _ in held], np.int64))
            features = np.concatenate([f for f, _ in held], axis=1)
            _, first, word = np.unique((features.astype(np.uint64) * weights).sum(axis=0), return_index=True, return_inverse=True)
            out.append((features[:, first], word.astype(np.int32), sizes, np.concatenate([x for _, x in held])))
            held, n = [], 0
    return out


def fit_field(parts: list, rounds: int = 40, rate: float = 0.3, l2: float = 2e-4, begun=None):
    """Weights of state 1's features, the five logs of moves and the bias, by the gradient of the likelihood over all of ``parts`` (see ``blocks``); from ``begun`` on, where given."""
    import numpy as np

    n = sum(len(word) for _, word, _, _ in parts)
    weights, moves, bias = begun or (np.zeros(DIMENSIONS), np.array([0.0, -2.0, 0.0, -1.0, -3.0]), -2.0)
    m, v = np.zeros(DIMENSIONS + 6), np.zeros(DIMENSIONS + 6)
    for t in range(1, rounds + 1):
        grad = np.concatenate([l2 * weights / n, np.zeros(6)])
        for features, word, sizes, label in parts:
            if not len(word):
                continue
            emission = (weights[features].sum(axis=0) + bias)[word]
            p, r, y, begin = marginals(emission, sizes, moves)
            inner = ~begin[1 : len(emission)]
            m00, m01, m10, m11, _ = np.exp(np.clip(moves, -20, 20))
            left, right = r[:-1][inner], y[1:][inner]
            both = np.stack([np.full(len(left), m00), m01 * right, m10 * left, m11 * left * right])
            both = (both / both.sum(axis=0)).sum(axis=1)
            la, lb = label[:-1][inner], label[1:][inner]
            seen = np.array([(~la & ~lb).sum(), (~la & lb).sum(), (la & ~lb).sum(), (la & lb).sum()])
            miss = (p - label) / n
            of_word = np.bincount(word, weights=miss, minlength=features.shape[1])
            for row in features:
                grad[:-6] += np.bincount(row, weights=of_word, minlength=DIMENSIONS)
            grad[-6:-2] += (both - seen) / n
            grad[-2:] += miss[np.flatnonzero(begin[:-1])].sum(), miss.sum()
        grad[0] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        weights, moves, bias = weights - step[:-6], moves - step[-6:-1], bias - step[-1]
    return weights, moves, bias


def document_values(p, sizes):
    """Per document: log odds of its likeliest toxic token, and log of the expected number of them."""
    import numpy as np

    filled = np.flatnonzero(sizes > 0)
    firsts = (np.cumsum(sizes) - sizes)[filled]
    top, total = np.zeros(len(sizes)), np.zeros(len(sizes))
    if len(filled):
        top[filled], total[filled] = np.maximum.reduceat(p, firsts), np.add.reduceat(p, firsts)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log(total + 0.01)])


def calibrate(values, y):
    """Logistic regression of the label on the document values, by Newton's method; counts are smoothed."""
    import numpy as np

    x = np.concatenate([values, np.ones((1, values.shape[1]))])
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        hess = (x * (p * (1 - p))) @ x.T + np.diag([0.05, 0.05, 1e-3])
        w = w + np.clip(np.linalg.solve(hess, x @ (goal - p) - np.array([0.05, 0.05, 1e-3]) * w), -3, 3)
    return w


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def hashed(batches):
    """(h, id, y, text) to (h, id, y, features)."""
    import pyarrow as pa

    for batch in batches:
        for part in shared.slices(batch, 3, DOCS_AT_ONCE, BYTES_AT_ONCE):
            found = [all_features(t).tobytes() for t in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.binary())], ["h", "id", "y", "features"])


def trainer(seed: int) -> Callable:
    """Batches of (.., y, features) to the model, or None."""

    def fit(batches):
        import numpy as np

        docs = []
        for batch in batches:
            docs += [(y == 1, np.frombuffer(f, np.int32).reshape(FAMILIES, -1)) for y, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        fold = np.random.Generator(np.random.PCG64(seed)).integers(0, FOLDS, len(docs))
        y = np.array([t for t, _ in docs], bool)
        rest = fold == 0
        if len(y) < 20 or not 0 < y[rest].sum() < rest.sum() or not 0 < y[~rest].sum() < (~rest).sum():
            return None
        limit = chosen_limit(docs, fold)
        if limit is None:
            return None

        def marks_of(some):
            counted = Counted()
            for toxic, features in some:
                counted.add(features, toxic)
            return counted.gains() >= limit

        seen = [d for d, out in zip(docs, rest, strict=True) if not out]
        marks = marks_of(seen)
        if not marks.any():
            return None
        weights, moves, bias = begun = fit_field(blocks(seen, marks))
        sizes = np.array([f.shape[1] for (_, f), out in zip(docs, rest, strict=True) if out], np.int64)
        emission = np.concatenate([weights[f].sum(axis=0) + bias for (_, f), out in zip(docs, rest, strict=True) if out])
        calibration = calibrate(document_values(probabilities(emission, sizes, moves), sizes), y[rest].astype(np.int64))
        weights, moves, bias = fit_field(blocks(docs, marks_of(docs)), rounds=10, rate=0.1, begun=begun)
        return {"weights": weights.astype(np.float32), "moves": moves, "bias": bias, "calibration": calibration, "limit": limit, "n_fit": len(seen), "n_docs": len(docs)}

    return fit


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, seed: int = 53, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The field and the calibration; None without both kinds of labels."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    sample = shared.labelled_texts(docs, known, rows, size, seed, id_col, text_col).select("h", "id", "y", "text")
    kind = sample.schema["id"].dataType.simpleString()
    return shared.fitted(sample.mapInArrow(hashed, f"h long, id {kind}, y int, features binary"), trainer(seed), "h", "id")


def scorer(model: dict | None) -> Callable:
    def score(texts):
        import numpy as np

        if model is None:
            return [0.0] * len(texts), [[] for _ in texts]
        found = [emissions(t, model["weights"], model["bias"]) for t in texts]
        sizes = np.array([len(x[0]) for x in found], np.int64)
        p = probabilities(np.concatenate([x[2] for x in found]), sizes, model["moves"])
        w = model["calibration"]
        scores = 1 / (1 + np.exp(-np.clip(w[:2] @ document_values(p, sizes) + w[2], -30, 30)))
        spans: list[list[dict]] = [[] for _ in texts]
        hot, to = np.flatnonzero(p >= 0.5), np.cumsum(sizes)
        doc = np.searchsorted(to, hot, side="right")
        for d in np.unique(doc).tolist():
            mine = hot[doc == d]
            starts, ends, _ = found[d]
            before = np.concatenate([[0], np.cumsum(np.frombuffer((texts[d] or "").encode(), np.uint8) & 0xC0 != 0x80)])
            for run in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1):
                i, j = run[[0, -1]] - (to[d] - sizes[d])
                spans[d].append({"start": int(before[starts[i]]), "end": int(before[ends[j]]), "p": float(p[run].max())})
        return scores, spans

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            for part in shared.slices(batch, 1, DOCS_AT_ONCE, BYTES_AT_ONCE):
                scores, spans = score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], [batch.schema.names[0], "score", "spans"])

    return run


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, score, spans (start and end in code points, highest marginal)."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(scorer(model), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double, spans array<struct<start: long, end: long, p: double>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and spans of all ``documents``."""
    docs = shared.table(spark, sf_dir, "documents")
    found = score(docs, train(docs, shared.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "spans")
