"""Helpers of the tests in this folder."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def with_clashes(df):
    """The same rows with columns named like what operators use inside, and like their results."""
    from pyspark.sql import functions as F

    for name in ("shard", "slot", "bucket", "position", "hash", "key", "k1", "h1", "row", "fp", "label", "term", "start", "maybe", "copies", "size", "score", "spans", "id", "y", "n", "at", "places", "kept"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def prose(rng, n, size=400):
    words = [f"w{i}" for i in range(size)]
    return " ".join(rng.choice(words) for _ in range(n))
