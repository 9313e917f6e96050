import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftloom.llm import lm_score


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: (v + r.standard_normal(v.shape) * 0.05).astype(np.float64) for k, v in lm_score.initial(np.ones(1024)).items()}
    ids = r.integers(0, 1024, (6, 5))
    _, g, _ = lm_score.loss_and_gradients(p, ids[:-1], ids[1:])
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        around = []
        for e in (1e-4, -1e-4):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += e
            around.append(lm_score.loss_and_gradients(q, ids[:-1], ids[1:])[0])
        assert g[k][at] == pytest.approx((around[0] - around[1]) / 2e-4, rel=0.01, abs=1e-6)


def test_scores_are_a_distribution_and_carry_the_state():
    p = lm_score.initial(np.ones(1024), 3)
    h = np.random.default_rng(1).standard_normal((1, 16)).astype(np.float32)
    logs = lm_score.output(p, np.repeat(h, 1024, 0), np.arange(1024))[0]
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    docs = [np.random.default_rng(i).integers(0, 1024, n) for i, n in enumerate((1, 40, 17, 700, 16, 33))]
    together = lm_score.document_scores(p, docs)
    for d, x in zip(docs, together, strict=True):
        table, state, last, total = lm_score.gate_inputs(p), np.zeros((1, 16), np.float32), np.array([0]), 0.0
        for t in d:
            state, _ = lm_score.step(p, table, last, state)
            total += lm_score.output(p, state, np.array([t]))[0][0]
            last = np.array([t])
        assert x == pytest.approx(total, rel=1e-4)


def brute(rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


def test_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10**6, None), (10**6 + 1, " \n"), (10**6 + 2, "word " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, ids string")
    monkeypatch.setattr(lm_score, "LOOKED_UP", 3000)
    got = lm_score.score_documents(df).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
    away = [r for r in got if r.held_out]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)


def test_empty(spark):
    assert lm_score.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = lm_score.score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert one.n_tokens == 3 and one.train_tokens == 3


def test_every_token_and_end_is_a_target_once(monkeypatch):
    monkeypatch.setattr(lm_score, "SEGMENT", 3 * lm_score.WINDOW)
    docs = [[*np.random.default_rng(n).integers(1, 1024, n - 1).tolist(), lm_score.END] for n in (1, 2, 31, 32, 33, 64, 94, 96, 97, 200)] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.list_(pa.int16()))], names=["seed", "ids"])
    segments = [b for b in lm_score._segment_batches(iter([batch]))]
    assert [t for b in segments for x in b.column(2).to_pylist() for t in x[1:]] == [t for d in docs for t in d]
    seen, real_one = [], lm_score.loss_and_gradients
    monkeypatch.setattr(lm_score, "loss_and_gradients", lambda p, i, t, real, h: (seen.extend(t[real].tolist()), real_one(p, i, t, real, h))[1])
    (out,) = lm_score._train_batches(lm_score.pack(lm_score.initial(np.ones(1024))))(iter(segments))
    assert sorted(seen) == sorted(t for d in docs for t in d) and out.column(0).to_pylist() == [len(seen)]


def test_training_carries_the_state():
    p = {k: v.astype(np.float64) for k, v in lm_score.initial(np.ones(1024), 2).items()}
    doc = np.random.default_rng(5).integers(0, 1024, 2 * lm_score.WINDOW + 1)
    lanes = lm_score._Lanes({k: v.copy() for k, v in p.items()})
    lanes.adam.rate = 0.0
    lanes.add(doc)
    lanes.learn()
    table, h = lm_score.gate_inputs(p), np.zeros((1, lm_score.HIDDEN))
    for t in doc[: lm_score.WINDOW]:
        h, _ = lm_score.step(p, table, np.array([t]), h)
    assert np.allclose(lanes.h, h, atol=1e-5) and lanes.at.tolist() == [lm_score.WINDOW]


def test_filled_up_windows_count_as_themselves():
    p = {k: v.astype(np.float64) for k, v in lm_score.initial(np.ones(1024), 2).items()}
    windows = [np.random.default_rng(n).integers(0, 1024, n) for n in (2, 5, 33)]
    block, real = lm_score._block(windows)
    loss, g, _ = lm_score.loss_and_gradients(p, block[:-1], block[1:], real)
    alone = [(len(w) - 1, *lm_score.loss_and_gradients(p, w[:-1, None], w[1:, None])[:2]) for w in windows]
    total = sum(n for n, _, _ in alone)
    assert loss == pytest.approx(sum(n * x for n, x, _ in alone) / total)
    for k in g:
        assert np.allclose(g[k], sum(n * x[k] for n, _, x in alone) / total, atol=1e-7)


def test_scores_do_not_follow_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = ({r.doc_id: r.score for r in lm_score.score_documents(docs.repartition(n)).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)


def test_score_from_training_to_result(spark):
    """The whole operator against the same steps taken one after the other in this process."""
    rows = [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 5 + i % 40))) for i in range(60)]
    got = {r.doc_id: r.score for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in t.split())
    ends = sum(not h for h in held.values())
    hash_of = lambda w: int(lm_score.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0].view(np.int64))
    order = sorted(c, key=lambda w: (-c[w], hash_of(w)))
    ids = {w: i + 2 for i, w in enumerate(order)}
    first = np.zeros(lm_score.VOCABULARY + 2)
    first[lm_score.END] = ends
    first[2 : 2 + len(order)] = [c[w] for w in order]
    flat = lm_score.pack(lm_score.initial(first))
    seeds = {r.doc_id: (r.s, r.d, r.k) for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(doc_id, text) s", "xxhash64(xxhash64(doc_id, text), 0) d", "0 k").collect()}
    for r in range(lm_score.ROUNDS):
        drawn = {x.i: x.h for x in spark.createDataFrame([(i, seeds[i][1]) for i in seeds], "i long, d long").selectExpr("i", f"xxhash64({r}, d) h").collect()}
        mine = sorted((i for i, _ in rows if not held[i] and seeds[i][1] % lm_score.ROUNDS == r), key=lambda i: drawn[i])
        lanes = lm_score._Lanes(lm_score.unpack(flat))
        for i in mine:
            while lanes.full():
                lanes.learn()
            lanes.add(np.array([lm_score.END, *(ids[w] for w in dict(rows)[i].split()), lm_score.END], np.int16))
        while lanes.lanes:
            lanes.learn()
        flat = lm_score.pack(lanes.p) if lanes.updates else flat
    p = lm_score.unpack(flat)
    for i, t in rows:
        want = lm_score.document_scores(p, [np.array([*(ids.get(w, lm_score.RARE) for w in t.split()), lm_score.END])])[0] / math.log(10)
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_gates_at_any_size():
    """States are those of the plain formulas, also where exp overflows."""
    p = lm_score.initial(np.ones(1024), 4)
    r = np.random.default_rng(6)
    table = (r.standard_normal((1024, 48)) * r.choice([0.1, 1, 200], (1024, 1))).astype(np.float32)
    h, n = r.uniform(-1, 1, (300, lm_score.HIDDEN)).astype(np.float32), lm_score.HIDDEN
    ids = r.integers(0, 1024, 300)
    x, w = table[ids].astype(float), p["wh"].astype(float)
    z, u = (1 / (1 + np.exp(-np.clip(x[:, a : a + n] + h @ w[:, a : a + n], -500, 500))) for a in (0, n))
    c = np.tanh(x[:, 2 * n :] + (u * h) @ w[:, 2 * n :])
    assert np.allclose(lm_score.step(p, table, ids, h)[0], h + z * (c - h), atol=1e-5)


def test_sums_by_id():
    ids, rows = np.array([5, 0, 5, 9, 0]), np.arange(10.0).reshape(5, 2)
    want = np.zeros((10, 2))
    np.add.at(want, ids, rows)
    assert np.array_equal(lm_score._sum_by(ids, rows, 10), want)


def test_output_without_targets():
    p = lm_score.initial(np.ones(1024))
    score, back = lm_score.output(p, np.zeros((0, lm_score.HIDDEN), np.float32), np.zeros(0, np.int64), {k: np.zeros_like(v) for k, v in p.items()})
    assert score.shape == (0,) and back.shape == (0, lm_score.HIDDEN)


def test_adam_over_all_parameters():
    """One array for all parameters gives the plain formulas."""
    r = np.random.default_rng(8)
    p = {k: v.astype(np.float64) for k, v in lm_score.initial(np.ones(1024), 5).items()}
    q, adam = {k: v.copy() for k, v in p.items()}, lm_score.Adam(p)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for t in range(1, 4):
        g = {k: r.standard_normal(x.shape) for k, x in p.items()}
        kept = {k: x.copy() for k, x in g.items()}
        adam.update(p, g, 0.5)
        for k in q:
            assert np.array_equal(g[k], kept[k])
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            q[k] -= 0.5 * lm_score.RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
            assert np.allclose(p[k], q[k], rtol=1e-9, atol=1e-12)
    assert adam.m.shape == lm_score.pack(p).shape


def test_scoring_takes_no_gradient(monkeypatch):
    """What only training needs, a fifth of the time of scoring, is not computed for scores."""
    asked, chosen = [], lm_score._chosen
    monkeypatch.setattr(lm_score, "_chosen", lambda x, target, *more: (asked.append(more), chosen(x, target, *more))[1])
    lm_score.document_scores(lm_score.initial(np.ones(1024)), [np.arange(40), np.arange(700) % 1024])
    assert set(asked) == {(False,)}
