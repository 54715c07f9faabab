import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Holds a DataFrame against a DuckDB query on the tables of a folder."""
    import math

    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v

    def run(df, sql, sf_dir):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = con.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(plain(v) for v in row) for row in found.fetchall()), key=repr)
        got = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=repr)
        assert got == want

    return run
