import pytest

from waypost import queries as engine

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_as_sql(spark, compare, name):
    compare(engine.QUERIES[name](spark, DATA), engine.SQL[name], DATA)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 29
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_have_sql():
    assert set(engine.SQL) == set(engine.QUERIES)
