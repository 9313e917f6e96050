import oracle
import pytest

from driftloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert oracle.differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.01") == ""
