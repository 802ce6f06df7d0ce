import pytest
from oracle import rows_of

from tarmill.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, name):
    a, b = rows_of(spark, data, QUERIES[name], SQL[name])
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows and any(v is not None for r in rows for v in r)


def test_entry_module_agrees():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
