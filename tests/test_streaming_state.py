"""Streams whose state lives in the state store or in versioned tables: any cut into micro-batches and any restart give the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import copula, trees
from driftloom.streaming import operators as streaming


@pytest.fixture
def rocks(spark):
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    yield spark
    spark.conf.set(name, before)


def stream_rows():
    r = np.random.default_rng(11)
    x = r.multivariate_normal([0] * 3, 0.7 + 0.3 * np.eye(3), 260)
    x[:, 1] = np.floor(2 * x[:, 1])
    gone = r.uniform(size=x.shape) < 0.3
    return [("ab"[i % 5 > 1], i, [None if gone[i, k] else float(x[i, k]) for k in range(2 if i < 120 else 3)]) for i in range(260)]


@pytest.mark.parametrize("cuts", [(0, 7, 100, 101, 230, 260), (0, 130, 260)])
def test_imputing_in_the_state_store(rocks, tmp_path, cuts):
    """Each micro-batch is its own run of the query: state comes back from the checkpoint."""
    spark, rows, schema = rocks, stream_rows(), "k string, i long, x array<double>"
    want = copula.impute_stream(spark.createDataFrame(rows, schema), "k", "i", "x", [1], 50, 20, samples=10)
    full = {k: sum(r[0] == k for r in rows) // 20 * 20 for k in "ab"}
    want = [tuple(r) for k in "ab" for r in want.where(F.col("key") == k).orderBy("row_id").collect()[: full[k]]]
    source, out, at = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(source)
        filled = streaming.impute_stream(spark.readStream.schema(schema).parquet(source), "k", "i", "x", [1], 50, 20, samples=10)
        filled.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] == pytest.approx(w[2]) and g[3] == pytest.approx(w[3]) and g[4] == w[4]


def test_planted_change_is_found_at_its_batch(spark):
    r = np.random.default_rng(5)
    law = [np.array([[1, s, 0], [s, 1, 0], [0, 0, 1.0]]) for s in (0.8, -0.8)]
    x = np.concatenate([r.multivariate_normal([0] * 3, law[i >= 6], 200) for i in range(12)])
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x.tolist())], "k string, i long, x array<double>")
    got = copula.impute_stream(df, "k", "i", "x", [], 400, 200, samples=199).groupBy(F.floor(F.col("row_id") / 200).alias("batch")).agg(F.min("p_change").alias("p"), F.max("p_change").alias("q")).collect()
    p = {g.batch: g.p for g in got}
    assert all(g.p == g.q for g in got) and p[0] is None
    assert [b for b, v in sorted(p.items()) if v is not None and v <= 0.01 and b > 1] == [6]
    drawn = copula.sample_correlations(np.random.default_rng(1), law[0], 50, 4000)
    plain = np.array([np.corrcoef(r.multivariate_normal([0] * 3, law[0], 50).T) for _ in range(4000)])
    assert np.allclose(drawn.mean(0), plain.mean(0), atol=0.01) and np.allclose(drawn.std(0), plain.std(0), atol=0.01)
    # from a new start the matrix follows at once
    state = copula.StreamState([], 400, samples=199)
    for b in range(7):
        state.step(x[200 * b : 200 * b + 200])
    assert state.since == 0 and state.sigma[0, 1] < -0.7


SCHEMA = "i long, a double, c string, y int"


def tree_rows():
    r = np.random.default_rng(4)
    a = r.uniform(0, 100, 400)
    near = [(i, float(v), "uv"[i % 2], None if i % 3 == 0 else int(v > 50)) for i, v in enumerate(a)]
    away = [(1000 + i, 150.0 + i % 7 if i % 2 else -50.0 - i % 5, f"w{i % 5}", i % 2) for i in range(200)]
    return [near[:150], near[150:300], near[300:], away[:100], away[100:]]


def made():
    return trees.TwoSpaces(trees.StreamTree("i", ["a"], [], "y", width=10.0, sibling_rows=30), trees.StreamTree("i", ["a"], ["c"], "y", width=10.0, sibling_rows=30))


def shape(both):
    return [(trees.describe(t.root), t.log, t.tight) for t in (both.x, both.z)]


def test_trees_go_on_after_a_restart(spark, tmp_path):
    """One run over all batches, a query started anew for each, and one whose last batch is tried again: the same splits, drifts and rows."""
    parts, want, said = tree_rows(), made(), []
    for rows in parts:
        said += [tuple(r) for r in want.step(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert ("split", 1) in want.x.log

    source, path, at = f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/checkpoint"
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        streaming.tree_batches(spark.readStream.schema(SCHEMA).parquet(source), made, path, at).awaitTermination()
    got = made().load(spark, f"{path}/tree/batch={len(parts) - 1}")
    assert shape(got) == shape(want)
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, said))

    again = made().load(spark, f"{path}/tree/batch={len(parts) - 2}")
    again.step(spark.createDataFrame(parts[-1], SCHEMA)).count()
    again.save(f"{path}/tree/batch={len(parts) - 1}")
    assert shape(made().load(spark, f"{path}/tree/batch={len(parts) - 1}")) == shape(want)
    files = {f.name for f in (tmp_path / "state" / "tree").iterdir()}
    assert files == {f"batch={len(parts) - k}" for k in (1, 2)}
