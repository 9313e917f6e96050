import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import ann


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x[ids == q][0] * x).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [int(ids[j]) for j in order]
    return out


def found(df, **more):
    out = {}
    for r in sorted(ann.search(df, F.col("id") % 20 == 0, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = exact(ids, x, ids[ids % 20 == 0], 20)
    got = found(df)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in got[q]} & set(want[q])) / 20 for q in want]
    print("recall", np.mean(hits))
    assert np.mean(hits) >= 0.9
    where = {int(i): j for j, i in enumerate(ids)}
    for q, v in got.items():
        assert np.allclose([s for _, s in v], [x[where[q]] @ x[where[i]] for i, _ in v], atol=1e-12)
        assert [(-s, i) for i, s in v] == sorted((-s, i) for i, s in v)


def test_copies_ties_and_odd_rows(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 8))
    x[40:260] = x[40]
    rows = [(i, v.tolist(), 1, "p") for i, v in enumerate(x)]
    rows += [(1000, None, 1, ""), (1020, [0.0] * 8, 1, ""), (1040, [None] + [1.0] * 7, 1, ""), (1060, [float("nan")] * 8, 1, ""), (1080, [float("inf")] * 8, 1, "")]
    rows += [(None, [1.0] * 8, 1, ""), (1100, [1.0], 1, ""), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int, v string")
    got = found(df, recall=1.0)
    want = exact(np.arange(300), x, range(0, 300, 20), 20)
    assert set(got) == set(want)
    assert [i for i, _ in got[40]] == want[40] and [i for i, _ in got[60]] == want[60]


def test_repeated_rows_leave_room_for_others(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 8))
    x[41] = 2 * x[40]  # the nearest of 40
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [rows[41]] * 50 + [rows[60]] * 3, "vec_id long, embedding array<double>")
    assert {q: [i for i, _ in v] for q, v in found(df, recall=1.0).items()} == exact(np.arange(300), x, range(0, 300, 20), 20)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert found(df) == {0: [(2, 1.0), (1, 0.0)]}
    assert found(df.limit(0)) == {}


def test_parts_are_balanced():
    x = np.random.default_rng(0).standard_normal((2000, 16))
    part = ann.balanced_parts(ann.nearest(x, x, 10, same=True), 16)
    assert np.bincount(part, minlength=16).max() <= np.ceil(2000 / 16 * 1.05) and part.min() >= 0
