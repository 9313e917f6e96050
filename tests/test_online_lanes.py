"""Streams that are learned together give what each gives row by row, however batches cut them."""

from copy import deepcopy

import numpy as np
import pyarrow as pa
import pytest

from driftloom.operators import online

OPTIONS = [{}, {"schedule": 0}, {"schedule": 1, "l1": 0.1, "l2": 0.3, "lp": 2.0}, {"schedule": 2}, {"schedule": 4, "drift": True, "blend": 0.02}]


def streams(seed, n, longest, ragged):
    r = np.random.default_rng(seed)
    cell = lambda: None if r.random() < 0.1 else float("nan") if r.random() < 0.05 else float(r.normal())
    row = lambda: None if ragged and r.random() < 0.05 else [cell() for _ in range(int(r.integers(0, 5)) if ragged else 4)]
    return [[(row(), None if r.random() < 0.2 else float(r.integers(0, 2))) for _ in range(int(r.integers(1, longest + 1)))] for _ in range(n)]


def by_row(rows, state=None, **options):
    return online.ftrl_rows([(i, x, y) for i, (x, y) in enumerate(rows)], state=state, **options)


def same_state(a, b):
    assert a.keys() == b.keys()
    for k, v in a.items():
        assert np.shape(v) == np.shape(b[k]) and np.allclose(v, b[k], rtol=1e-9, atol=1e-9), k


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("n, ragged", [(40, False), (40, True), (5, True)])
def test_together_and_row_by_row(options, n, ragged):
    some = streams(1, n, 120, ragged)
    ends = np.cumsum([len(s) for s in some]).tolist()
    runs = list(zip([0, *ends[:-1]], ends, strict=True))
    first = by_row([([1.0, 2.0, 0.5], 1.0), ([0.1], 0.0)])[1]
    flat = [c for s in some for c in s]
    out, states = online.ftrl_streams(runs, pa.array([x for x, _ in flat], pa.list_(pa.float64())), pa.array([y for _, y in flat], pa.float64()), deepcopy(first), **options)
    for i, (a, z) in enumerate(runs):
        found, state = by_row(some[i], deepcopy(first) if i == 0 else None, **options)
        want = np.array([[np.nan if v is None else v for v in r[1:]] for r in found], float).T
        assert np.allclose(out[:, a:z], want, rtol=1e-9, atol=1e-9, equal_nan=True)
        same_state(state, states[i])


@pytest.mark.parametrize("size", [7, 500])
def test_streams_over_batches(spark, size):
    some = streams(2, 60, 40, True)
    rows = [(k, i, x, y) for k, s in enumerate(some) for i, (x, y) in enumerate(s)]
    df = spark.createDataFrame(rows, "k long, i long, x array<double>, y double").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {(r.key, r.row_id): (r.score, r.p, r.loss, r.decay) for r in online.replay(df, "k", "i", "x", "y").collect()}
        start = by_row([([0.5, 1.0], 1.0)])[1]
        states = {r.key: r.state.asDict() for r in online.learned(df, "k", "i", "x", "y", start_from=start).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and states.keys() == set(range(60))
    for k, s in enumerate(some):
        for i, want in enumerate(by_row(s)[0]):
            assert np.allclose(np.array(got[k, i], float), np.array(want[1:], float), rtol=1e-9, atol=1e-9, equal_nan=True)
        same_state(states[k], by_row(s, deepcopy(start))[1])
