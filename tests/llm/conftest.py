import random

import pytest
from helpers_llm import DOCS, prose


@pytest.fixture(scope="session")
def rows():
    """Documents with every odd case: nulls, empty and long texts, repeated rows and ids, ties."""
    rng = random.Random(1)
    out = [(i, prose(rng, rng.randint(5, 120)), "en", f"s{i % 3}", 1) for i in range(60)]
    long = prose(rng, 30_000)
    out += [
        (None, prose(rng, 40), "en", "s0", 1), (None, None, None, None, None), (100, None, "en", "s1", 0), (101, "", "en", None, 0), (102, " \n\t ", "en", "s0", 3), (103, long, "en", "s2", 1), (104, "é ü 😀 ñ <|endoftext|> x", "fr", "s1", 9),
        (105, "a" * 5000, "en", "s1", 1), (106, "\n".join(["same line here"] * 30), "en", "s1", 1), (107, "x\x00y  z w \r\n q", "en", "s1", 1),
    ]
    out += [out[3]] * 3 + [(5, prose(rng, 50), "en", "s0", 1)] + [(200 + i, out[7][1], "en", "s0", 1) for i in range(5)]
    return out


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def folder(tmp_path, spark):
    """Writes tables as the driver keeps them: name to (rows, schema)."""

    def write(**tables):
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
