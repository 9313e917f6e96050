import random
from collections import defaultdict

import numpy as np
import pytest

from driftloom.llm import mixing


def by_hand(sizes):
    """Targets by repeated resharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full, target = sum(sizes.values()) * 1.5, set(), {}
    while len(full) < len(names):
        level = left / sum(w[s] for s in names if s not in full)
        over = [s for s in names if s not in full and level * w[s] >= 2 * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in names if s not in full}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            full.add(s)
    return target


def check(spark, rows):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    out = mixing.mix(df).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df).collect()))
    assert len(out) == len(rows)
    sizes, taken, lengths, got = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        lengths[r.source] = max(lengths[r.source], r.size)
        got[r.source] = r.target
    want = by_hand(sizes)
    for s in sizes:
        assert got[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 1 + lengths[s]
    return out


def test_random_tables(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * 1 for _ in range(r.choice((1, 2, 3, 7, 20, 90)))), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    rows += [(1, None, "a"), (1, "", "z"), (None, "x y", None), (3, "same here", "b"), (3, "same here", "b")]
    rows += [(5000 + i, "same words", "a") for i in range(3000)]
    check(spark, rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = check(spark, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 3 for s in taken)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_knapsack_is_exact():
    r = np.random.default_rng(3)
    for _ in range(40):
        lengths, counts, budget = np.unique(r.integers(1, 60, 6)), None, int(r.integers(0, 300))
        counts = r.integers(0, 5, len(lengths))
        reach = {0}
        for n, c in zip(lengths, counts, strict=True):
            reach = {x + n * k for x in reach for k in range(c + 1)}
        got = mixing.knapsack(lengths, counts, budget)
        assert (got <= counts).all()
        assert (got * lengths).sum() == max(x for x in reach if x <= budget)
