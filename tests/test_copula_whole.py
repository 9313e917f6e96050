from statistics import NormalDist

import numpy as np
import pytest

from driftloom.operators import copula
from driftloom.plans import imputation
from driftloom.plans.tables import masked_long

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def latent_rows(spark, sf_dir):
    return copula.rows_of(copula.latent(masked_long(spark, sf_dir), imputation.ORDINAL), 4).cache()


def test_online_em_takes_all_batches(spark, monkeypatch):
    rows, want = latent_rows(spark, SMALL), np.eye(4)
    for j in range(5):
        d = copula.batch_decay(j + 1, True)
        want = d * copula.moments(rows.where(f"floor(row_id / 200) = {j}"), want) + (1 - d) * want
    monkeypatch.setattr(copula, "CHAIN", 2)
    assert np.allclose(copula.fit_batches(rows, 4, 200), want)
    asked = []
    monkeypatch.setattr(copula, "_add_rows", lambda sums, pdf, sigma: sums)
    real = copula.fit_batches
    monkeypatch.setattr(copula, "fit_batches", lambda rows, width, size, count=None: (asked.append((size, count)), real(rows, width, size, count))[1])
    imputation.copula_imputed(spark, SMALL)
    assert asked == [(500, None)]


def test_change_is_tested_between_all_neighbours(spark):
    rows = latent_rows(spark, SMALL)
    got = {r.batch: tuple(r)[1:] for r in copula.batch_changes(rows, 4, 250, samples=20).collect()}
    assert sorted(got) == [1, 2, 3]
    for j, p in got.items():
        old = copula.fit(rows.where(f"floor(row_id / 250) = {j - 1}"), 4)
        new = copula.moments(rows.where(f"floor(row_id / 250) = {j}"), old)
        assert p == pytest.approx(copula.change_test(spark, old, new, 250, samples=20))
    assert sorted(r.batch for r in imputation.copula_change(spark, MORE).collect()) == list(range(1, 20))


def test_matrix_is_fitted_until_it_stands_still(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(copula, "moments", lambda rows, sigma: (rounds.append(1), np.eye(4) + (len(rounds) < 20) * (1 + len(rounds)))[1])
    imputation.copula_matrix(spark, SMALL)
    assert len(rounds) > 20


def test_values_are_inverted_exactly(spark):
    r = np.random.default_rng(3)
    x = r.multivariate_normal([0, 0, 0], [[1, 0.9, 0.9], [0.9, 1, 0.9], [0.9, 0.9, 1]], 1500)
    level = np.where(x[:, 2] < -2.9, 0.25, np.where(x[:, 2] > 2.7, 7.5, 3.0))  # the ends are rarer than one in 200
    assert 0 < (level == 7.5).mean() < 0.005
    value = np.column_stack((np.exp(3 * x[:, 0]), x[:, 1], level))
    rows = [(i, k, None if i % 3 == k else float(value[i, k])) for i in range(1500) for k in range(3)]
    cells = spark.createDataFrame(rows, "row_id long, feature_id int, value double")
    sigma = copula.to_correlation(np.cov(x.T))
    z = {a.row_id: a.x for a in copula.expectation(copula.rows_of(copula.latent(cells, [2]), 3), sigma).collect()}
    got = {(a.row_id, a.feature_id): a.value for a in copula.impute(cells, [2], 3, sigma).collect()}
    assert len(got) == len(rows)
    for k in range(3):
        seen = np.sort([v for _, f, v in rows if f == k and v is not None])
        for i in range(k, 1500, 3):
            q = NormalDist().cdf(z[i][k])
            want = np.quantile(seen, q) if k < 2 else seen[np.clip(int(np.ceil(np.round((len(seen) + 1) * q - 1, 3))), 0, len(seen) - 1)]
            assert got[i, k] == pytest.approx(want, rel=1e-5, abs=1e-9)
