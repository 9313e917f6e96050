"""The change test along a stream looks at all of its samples at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import copula


def test_norms_of_many_pairs_at_once():
    r = np.random.default_rng(3)
    law = copula.to_correlation(np.cov(r.normal(size=(4, 30))))
    old, new = (copula.sample_correlations(r, law, n, 40) for n in (200, 50))
    assert copula.frobenius(old, new) == pytest.approx([copula.differences(a, b)[0] for a, b in zip(old, new, strict=True)], rel=1e-9)


def test_one_matrix_is_decomposed_alone_in_a_batch(monkeypatch):
    alone, real = [], copula.differences
    monkeypatch.setattr(copula, "differences", lambda a, b: alone.append(1) or real(a, b))
    r, state = np.random.default_rng(4), copula.StreamState([], 200, samples=100)
    for _ in range(3):
        x = r.normal(size=(50, 3))
        x[::2, 1] = np.nan
        state.step(x)
    assert len(alone) == 2 and 0 < state.p_change <= 1


def test_few_streams_are_in_tasks_of_their_own(spark):
    rows = spark.createDataFrame([(i % 4, i, [float(i % 7), None if i % 3 else 1.0]) for i in range(400)], "stream long, row_id long, x array<double>")
    got = copula.impute_stream(rows, "stream", "row_id", "x", [], 20, 10).withColumn("task", F.spark_partition_id())
    tasks = got.groupBy("task").agg(F.collect_set("key").alias("keys")).collect()
    assert sorted(r["keys"] for r in tasks) == [[0], [1], [2], [3]]
