import os
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from helpers_llm import DOCS, prose
from test_decontaminate import brute as contaminated
from test_neardup import brute_groups
from tokenizers import Tokenizer

from waypost.llm import quality


def test_stages_against_brute_force(spark, rows, folder):
    rng = random.Random(9)
    items = [(i, prose(rng, 25, 3000)) for i in range(5)]
    fresh = [(3000 + i, prose(rng, 60, 3000), "en", f"s{i % 4}", 1) for i in range(120)]
    tainted = [(4000 + i, prose(rng, 40, 3000) + " " + items[i % 5][1], "en", "s1", 1) for i in range(10)]
    copies = [(6000 + i, fresh[i % 7][1], "en", "s2", 1) for i in range(30)]
    data = rows + fresh + tainted + copies
    at = folder(documents=(data, DOCS), benchmark=(items, "item_id long, text string"), labels=([], "doc_id long, quality int, toxic int"))

    good = [r for r in data if not quality.base_failed(quality.measure(r[1])[0])]
    roots = brute_groups([r[1] for r in good])
    first = {}
    for r in sorted(set(good), key=lambda r: (r[0] is not None, r[0] or 0)):
        first.setdefault(roots[r[1]], r)
    clean = [r for r in first.values() if not contaminated([r], items)[0][-1]]

    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        path = f"{at}/stage-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.collect())
    of = lambda rs: sorted((r[0] is not None, r[0] or 0) for r in rs)
    assert ids(seen[0]) == of(good) and ids(seen[1]) == of(first.values()) and ids(seen[2]) == of(clean)
    assert all(set(df.columns) == {"doc_id", "text", "lang", "source", "n_chars"} for df in seen[:4])
    mixed = ids(seen[3])
    assert set(mixed) <= set(of(clean)) and max(mixed.count(x) for x in mixed) <= 3
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in seen[3].collect())
    assert ids(seen[4]) == mixed and seen[4].agg({"n_tokens": "sum"}).first()[0] == tokens
    again = corpus_pipeline.run(spark, at).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, seen[4].collect())) and np.int64(len(again)) == len(mixed)


def test_tables_on_the_way_are_forgotten(spark, docs):
    from waypost.llm import shared

    df = shared.written(docs, "some")
    path = shared._paths[-1].removeprefix("file://")
    assert df.count() == docs.count() and os.path.isdir(path)
    shared.forget(spark)
    assert not os.path.exists(path)


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
