import pytest

import __spark_entry__
from attestra.plans import queries, roundtrips  # noqa: F401
from tests.compare import check, duck


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_agrees_with_sql(name, spark, sf_dir):
    check(name, queries.QUERIES[name], queries.ORACLES[name], spark, duck(sf_dir), sf_dir)


#: Held against plain loops in test_pages.
BY_LOOPS = {"f12_f17_regions", "g10_documents", "g3_g6_flagship", "g12_rollup", "j7_summary"}


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES and n not in BY_LOOPS])
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    rows = out.collect()
    assert rows and all(0 <= r.overall_tampering_risk <= 100 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
