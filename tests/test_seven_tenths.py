"""The split of a stream, for lengths whose seven tenths a double rounds down."""

import duckdb
import pytest

import oracle
from driftloom.plans import registry


@pytest.mark.parametrize("name", ["online_holdout", "online_predict"])
def test_a_stream_of_ninety_is_split_after_sixty_three(spark, tmp_path, name):
    duckdb.sql("""SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE AS ts, CASE WHEN i < 90 THEN 1 WHEN i < 260 THEN 2 ELSE 3 END::BIGINT AS user_id,
        CASE WHEN i % 3 = 0 THEN 'purchase' ELSE 'view' END AS event_type, (i * 37 % 101)::DOUBLE AS value, '{"k": ' || (i * 13 % 100) || '}' AS props FROM range(270) t(i)""").write_parquet(f"{tmp_path}/events.parquet")  # fmt: skip
    assert oracle.differences(spark, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path)) == ""
    if name == "online_holdout":
        rows = registry.queries()[name](spark, str(tmp_path)).collect()
        assert {r.user_id: (r.train, r.test) for r in rows} == {1: (63, 27), 2: (119, 51), 3: (7, 3)}
