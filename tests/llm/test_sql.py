import pytest

from attestra.llm import queries
from tests.compare import check, duck


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_agrees_with_sql(name, spark, sf_dir):
    check(name, queries.QUERIES[name], queries.ORACLES[name], spark, duck(sf_dir), sf_dir)
