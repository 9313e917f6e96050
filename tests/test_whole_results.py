"""Whole results of queries that SQL cannot express, against dense or row-by-row computations."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_two_spaces import PlainStream, plain_stream

from driftloom.operators import copula, frames, svm
from driftloom.plans import imputation, vectors
from driftloom.plans.tables import FEATURES, masked_long, matrix

SMALL = "/root/testdata/sf0.001"
N = NormalDist()


def long_rows(rows):
    return {(r.key, r.row_id, r.feature_id): r.value for r in rows}


def wanted(rows, last_only=False):
    out = {}
    for s in range(4):
        mine = [(i, x) for k, i, x in rows if k == s]
        if not last_only:
            done = plain_stream(mine, {2, 3}, 200, 50)
        else:
            state, done = LastOnly({2, 3}, 200), {}
            for a in range(0, len(mine), 50):
                for (i, _), v, z in zip(mine[a : a + 50], *state.batch([x for _, x in mine[a : a + 50]]), strict=True):
                    done[i] = (v, z)
        out |= {(s, i, k): v for i, (values, _) in done.items() for k, v in enumerate(values)}
    return out


class LastOnly(PlainStream):
    """After the first batch only its last row enters the windows."""

    def batch(self, rows):
        if not self.batches:
            return super().batch(rows)
        kept = {k: list(v) for k, v in self.seen.items()}
        for k, v in enumerate(rows[-1]):
            if v is not None:
                kept[k] = (kept.get(k, []) + [v])[-self.window :]
        self.seen = Frozen(kept)
        return super().batch(rows)


class Frozen(dict):
    """Windows that a batch cannot change."""

    def __missing__(self, k):
        return []

    def __setitem__(self, k, v):
        pass


def same(got, want):
    assert got.keys() == want.keys()
    far = [k for k in want if (got[k] is None) != (want[k] is None) or got[k] is not None and abs(got[k] - want[k]) > 1e-6 * max(1, abs(want[k]))]
    assert not far, (len(far), [(k, got[k], want[k]) for k in far[:3]])


def masked(spark):
    return matrix(spark, SMALL).select((F.col("user_id") % 4).alias("key"), "row_id", frames.mask_pairs(F.array(*FEATURES), F.col("row_id")).alias("x"))


def test_copula_stream(spark):
    same(long_rows(imputation.copula_stream(spark, SMALL).collect()), wanted(masked(spark).orderBy("row_id").collect()))


def test_copula_trapezoid(spark):
    rows = masked(spark)
    shown = rows.withColumn("x", frames.trapezoid(F.col("x"), F.col("row_id"), F.lit(rows.count()))).orderBy("row_id").collect()
    same(long_rows(imputation.copula_trapezoid(spark, SMALL).collect()), wanted(shown, last_only=True))


class Columns(PlainStream):
    """Latents by whole columns, and steps of the matrix over given rows."""

    def __init__(self, cells, ordinal):
        super().__init__(ordinal, 10**9)
        rows = {}
        for i, k, v in cells:
            rows.setdefault(i, [None] * 4)[k] = v
            if v is not None:
                self.seen[k].append(v)
        memo = {}
        at = lambda k, v: memo.setdefault((k, v), self.latent(k, v))
        self.sigma = np.eye(4)
        self.rows = {i: [None if v is None else at(k, v) for k, v in enumerate(r)] for i, r in sorted(rows.items())}
        # a row without any observed cell has no latents
        self.ids = sorted(self.rows)

    def latent(self, k, v):
        z, lo, hi = super().latent(k, v)
        if k in self.ordinal:  # the middle of the level's mass
            n, below, upto = len(self.seen[k]), sum(a < v for a in self.seen[k]), sum(a <= v for a in self.seen[k])
            z = N.inv_cdf((below + upto) / 2 / n)
        return z, lo, hi

    def own(self, ids):
        done = [self.row(self.rows[i]) for i in ids]
        x = np.array([a for a, _ in done])
        c = np.cov(x.T) + sum(c for _, c in done) / (len(ids) - 1)
        d = np.sqrt(np.diag(c))
        return c / np.outer(d, d)


@pytest.fixture(scope="module")
def columns(spark):
    return Columns([tuple(r) for r in masked_long(spark, SMALL).select("row_id", "feature_id", "value").collect()], {2, 3})


def test_copula_matrix(spark, columns):
    columns.sigma = np.eye(4)
    for _ in range(50):
        new = columns.own(columns.ids)
        still = np.linalg.norm(columns.sigma - new) / np.linalg.norm(columns.sigma) < 0.01
        columns.sigma = new
        if still:
            break
    got = np.zeros((4, 4))
    for r in imputation.copula_matrix(spark, SMALL).collect():
        got[r.i, r.j] = r.rho
    assert np.allclose(got, columns.sigma, atol=1e-7)


@pytest.mark.parametrize("query, batches", [("copula_imputed", 2), ("copula_imputed_shares", 10)])
def test_copula_imputed(spark, columns, query, batches):
    columns.sigma, size = np.eye(4), 1000 // batches
    for j in range(batches):
        d = 8 / (j + 1 + 8)
        columns.sigma = d * columns.own([i for i in columns.ids if i // size == j]) + (1 - d) * columns.sigma
    want = {}
    for r in masked_long(spark, SMALL).collect():
        ring = sorted(columns.seen[r.feature_id])
        v = r.value
        if v is None:
            q = N.cdf(columns.row(columns.rows[r.row_id])[0][r.feature_id])
            v = float(np.quantile(ring, q)) if r.feature_id < 2 else ring[min(max(math.ceil(round((len(ring) + 1) * q - 1, 3)), 0), len(ring) - 1)]
        want[0, r.row_id, r.feature_id] = v
    same({(0, r.row_id, r.feature_id): r.value for r in getattr(imputation, query)(spark, SMALL).collect()}, want)


def test_three_norms():
    r = np.random.default_rng(2)
    a, b = (np.corrcoef(r.standard_normal((5, 40)) + r.standard_normal(40)) for _ in range(2))
    got = copula.differences(a, b)
    m = np.linalg.inv(np.linalg.cholesky(a))  # any root of a gives the same singular values for a symmetric difference
    s = np.abs(np.linalg.eigvalsh(m @ b @ m.T - np.eye(5)))
    assert got == pytest.approx((np.sqrt((s**2).sum()), s.max(), s.sum()))


def test_subspace_distance(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = {k: np.corrcoef(np.array([r.embedding for r in rows if (r.label < 5) == k], float).T) for k in (True, False)}
    x["random"] = svm.random_correlation(64, 1)
    top = {}
    for k, c in x.items():
        w, v = np.linalg.eigh(c)
        top[k] = (v[:, ::-1][:, :3], w[::-1][:3])
    got = {r.against: (r.angle, r.gap) for r in vectors.subspace_distance(spark, SMALL).collect()}
    for name, k in (("others", False), ("random", "random")):
        angle = np.arccos(np.clip(np.linalg.svd(top[True][0].T @ top[k][0], compute_uv=False), -1, 1))
        assert got[name] == pytest.approx((np.sqrt((angle**2).sum()), np.linalg.norm(top[True][1] - top[k][1])), abs=1e-7)


def descended(phi, y, lam=1e-3):
    """Scores of a dense machine with the same objective, each step descended until the gradient vanishes."""
    known = ~np.isnan(y)
    s, b, w = 2 * y[known] - 1, (2 * y[known] - 1).mean(), np.zeros(phi.shape[1])
    for share in (0.0, 1e-6, 1e-4, 0.01, 0.1, 0.5, 1.0):
        def parts(w, share=share):
            f = phi @ w + b
            m, e = 20 * (1 - s * f[known]), np.exp(-3 * f[~known] ** 2)
            p = 1 / (1 + np.exp(-m))
            value = np.logaddexp(0, m).mean() / 20 + share * e.mean() + lam * w @ w
            slope = np.zeros(len(y))
            slope[known], slope[~known] = -s * p / known.sum(), share * -6 * f[~known] * e / (~known).sum()
            bend = np.zeros(len(y))
            bend[known], bend[~known] = 20 * p * (1 - p) / known.sum(), share * (36 * f[~known] ** 2 - 6) * e / (~known).sum()
            return value, slope @ phi + 2 * lam * w, (phi.T * bend) @ phi + 2 * lam * np.eye(len(w))

        for _ in range(200):
            value, g, h = parts(w)
            if np.abs(g).max() < 1e-10:
                break
            e, v = np.linalg.eigh(h)
            d = v @ ((v.T @ g) / np.maximum(np.abs(e), 1e-8))
            size = 1.0
            while size > 1e-9 and parts(w - size * d)[0] > value - 1e-4 * size * (g @ d) + 1e-15 * abs(value):
                size /= 2
            w = w - size * d
        assert np.abs(parts(w)[1]).max() < 1e-6
    return phi @ w + b


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], float), np.array([float(r.label < 5) if r.vec_id % 4 == 0 else np.nan for r in rows])


def held(rows, f):
    """Predictions are the scores' signs, and the probabilities one logistic curve over them."""
    got = sorted((r.vec_id, r.predicted, r.probability) for r in rows)
    assert len(got) == len(f)
    sure = np.abs(f) > 1e-5
    assert all(g[1] == int(v >= 0) for g, v in zip(np.array(got, object)[sure], f[sure], strict=True))
    logit = np.array([math.log(p / (1 - p)) for _, _, p in got])
    a, b = np.polyfit(f, logit, 1)
    assert a > 0 and np.abs(a * f + b - logit).max() < 1e-6 * max(1, a)


def test_transductive_svm(spark, embeddings):
    held(vectors.transductive_svm(spark, SMALL).collect(), descended(*embeddings))


def test_transductive_svm_sparse(spark, embeddings):
    x, y = embeddings
    held(vectors.transductive_svm_sparse(spark, SMALL).collect(), descended(np.where(np.abs(x) > np.float32(0.1), x, 0.0), y))


def test_transductive_svm_radial(spark, embeddings):
    """Whitened by another root of the basis' products, which gives the same function."""
    x, y = embeddings
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("vec_id") % 4 == 0, 1.0).alias("y"))
    drawn = svm.KernelMap.drawn(rows, 1.0, 200, 1000, 1)
    assert len(drawn.basis) == 200 and len(drawn.sample) == np.isnan(y).sum()
    k = lambda a, b: np.exp(-np.array([((b - r) ** 2).sum(1) for r in a]) / 2)
    u = drawn.sample
    centred = k(x, drawn.basis) - k(x, u).mean(1)[:, None] - k(u, drawn.basis).mean(0)[None, :] + k(u, u).mean()
    gram = k(drawn.basis, drawn.basis) - k(drawn.basis, u).mean(1)[:, None] - k(u, drawn.basis).mean(0)[None, :] + k(u, u).mean()
    root = np.linalg.cholesky(gram + 1e-12 * np.eye(200))
    held(vectors.transductive_svm_radial(spark, SMALL).collect(), descended(np.linalg.solve(root, centred.T).T, y))


def test_more_features_than_curvature_takes(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.standard_normal((120, 5)) + (np.arange(120) % 2)[:, None]
    df = spark.createDataFrame([(v.tolist(), int(i % 2) if i % 3 == 0 else None) for i, v in enumerate(x)], "x array<double>, y int")
    one = svm.TransductiveSVM().fit(df, "x", "y").w
    monkeypatch.setattr(svm.TransductiveSVM, "CURVED", 2)
    assert np.allclose(svm.TransductiveSVM(still=1e-5).fit(df, "x", "y").w, one, atol=1e-3)


def test_linear_grid_reaches_the_least_objective(spark):
    """At each cost no nearby weights do better, and a long plain descent ends no lower."""
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 10 < 7").collect()
    x, y = np.array([r.embedding for r in rows], float), np.array([1.0 if r.label < 5 else -1.0 for r in rows])
    sd = x.std(0, ddof=1)
    for r in vectors.linear_svm_grid(spark, SMALL).collect():
        lam = 1 / (2 * r.cost * len(rows))
        goal = lambda w, b: np.maximum(0, 1 - y * (x @ w + b)).mean() + lam / 2 * ((w * sd) ** 2).sum()  # noqa: B023, E731
        w, b, best = np.zeros(x.shape[1]), 0.0, np.inf
        for t in range(4000):
            on = y * (x @ w + b) < 1
            gw, gb = -(y[on] @ x[on]) / len(y) + lam * w * sd * sd, -y[on].sum() / len(y)
            step = 2.0 / (1 + t) ** 0.6
            w, b = w - step * gw, b - step * gb
            best = min(best, goal(w, b))
        assert r.objective <= best + 2e-3 * max(best, 0.05)


def test_random_correlation_as_rows(spark):
    got = {(r.i, r.j): r.rho for r in svm.random_correlation_rows(spark, 18, 3).collect()}
    m = np.array([[got[i, j] for j in range(18)] for i in range(18)])
    assert np.allclose(m, m.T) and (np.diag(m) == 1).all() and np.linalg.eigvalsh(m).min() > -1e-9
    u = lambda i, k: ((((i * 1103515245 + k * 12345 + 3) % 2147483648) * 48271 + 11) % 2147483647 + 1) / 2147483648
    w = np.array([[N.inv_cdf(u(i, k)) for k in range(18)] for i in range(18)])
    c = w @ w.T
    assert np.allclose(m, c / np.sqrt(np.outer(np.diag(c), np.diag(c))))
    again = {(r.i, r.j): r.rho for r in svm.random_correlation_rows(spark, 18, 4).collect()}
    assert again != got
