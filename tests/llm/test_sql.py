import pytest

from waypost.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mixing_targets", "quality_base"])
def test_as_sql(spark, compare, name):
    compare(queries.queries()[name](spark, DATA), queries.oracle_sql()[name], DATA)
