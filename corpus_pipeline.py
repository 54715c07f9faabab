"""From raw documents to token shards: filter, deduplicate, decontaminate, mix, encode.

Each stage takes what its predecessor kept; all but the last return the columns of
``documents``.  The classifier, fingerprints and rounding can't be
expressed in SQL, so there is no ``ORACLE_SQL``; the tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waypost.llm import decontaminate, mixing, neardup, quality, shared, sstable

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the classifier reject."""
    return quality.keep_good(docs, quality.train(docs, shared.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: covering SimHash fingerprints, widened by MinHash, confirmed by an exact similarity of 0.8 or more of the five-word shingles."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops and repeats documents to meet the sources' targets."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the documents into shards; per document, what is read back from them."""
    folder = shared.fresh_path(spark, "sstable")
    return sstable.read_table(sstable.write_table(docs, folder, TOKENIZER), folder)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
