import pytest

from tamiz.llm import queries

_ORACLES = queries.oracles()


@pytest.mark.parametrize("name", sorted(_ORACLES))
def test_same_as_sql(name, compare):
    compare(queries.QUERIES[name], _ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(_ORACLES)))
def test_runs(name, spark, data):
    queries.QUERIES[name](spark, data).collect()
