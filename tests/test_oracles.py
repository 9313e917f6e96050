import pytest

import oracle
from driftloom.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert oracle.differences(spark, registry.queries()[name], SQL[name], "/root/testdata/sf0.001") == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["user_id", "row_id", "p", "cer"]
    assert set(e.oracle_sql()) <= set(e.queries())
