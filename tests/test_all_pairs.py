"""All pairs without rows for them: what is stored and shuffled, and results on ties, equal points and several tiles."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from driftloom.operators import density
from driftloom.operators.lineage import folder
from driftloom.plans import registry


def written(spark) -> int:
    """Bytes of checkpoints and of shuffles so far."""
    local = folder(spark).removeprefix("file:")
    stored = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(local) for f in names)
    return stored + spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """A folder with 3000 vectors: 0.8 MB, and 4.5 million pairs."""
    at, r = tmp_path_factory.mktemp("many"), np.random.default_rng(5)
    x = (r.normal(size=(3000, 64)) / 8).astype(np.float32)
    columns = {"vec_id": pa.array(np.arange(3000)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array((np.arange(3000) % 10).astype(np.int32))}
    pq.write_table(pa.table(columns), at / "embeddings.parquet")
    return str(at)


#: MB that each query may store and shuffle; the points are 1.5 MB as doubles.
MOST = {
    "density_peaks": 8,
    "density_clusters": 8,
    "peak_count": 8,
    "peak_order": 8,
    "bisected_cutoff": 8,
    "distance_cutoff_counted": 8,
    "distance_cutoff": 8,
    "label_spreading_nearest": 60,
    "growing_peaks": 42,
    "densities": 4,
    "pair_distances": 4,
    "cutoff_densities": 4,
}


@pytest.mark.parametrize("name", MOST)
def test_pairs_are_neither_stored_nor_shuffled(spark, many, name):
    before = written(spark)
    registry.queries()[name](spark, many).collect()
    assert written(spark) - before < MOST[name] * 1e6


def block(ids, x, **more):
    t = pa.table({"id": ids, "x": pa.array(x.tolist(), pa.list_(pa.float64())), **more})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return density.Block(sink.getvalue().to_pybytes())


@pytest.fixture(scope="module")
def tied():
    """(ids, x, d): points on a grid, many of them equal, far from the origin; more than one tile of them."""
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(1500, 3)), 1) + 50
    x[100:130] = x[0]
    ids = r.permutation(1500)
    return ids, x, np.array([np.sqrt(((x - v) ** 2).sum(1)) for v in x])


def test_nearest_denser_points_among_ties(tied):
    ids, x, d = tied
    rho = (d < 0.5).sum(1) - 1.0
    a, b = (block(ids[s], x[s], rho=rho[s]) for s in (slice(0, 1200), slice(1200, None)))
    inner, other, between = (density._nearest_denser(*pair) for pair in ((a, a), (b, b), (a, b)))
    assert np.sqrt(max(f for *_, f in (inner, other, between))) == pytest.approx(d.max(), abs=1e-9)
    for own, cross, at in ((inner[0], between[0], range(1200)), (other[0], between[1], range(1200, 1500))):
        for k, i in enumerate(at):
            up = np.flatnonzero((rho > rho[i]) | ((rho == rho[i]) & (ids < ids[i])))
            want = min(zip(d[i, up], ids[up], strict=True), default=(np.inf, np.iinfo(np.int64).max))
            assert min((own.d[k], own.p[k]), (cross.d[k], cross.p[k])) == want


@pytest.fixture(scope="module")
def packed(spark, tied):
    ids, x, _ = tied
    return density.blocks(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, x array<double>"), 400).persist()


def test_densities_of_tied_points(packed, tied):
    ids, _, d = tied
    for gaussian in (True, False):
        w = np.exp(-((d / 0.5) ** 2)) if gaussian else d < 0.5
        got = {r.id: r.rho for r in density.densities(packed, 0.5, gaussian).collect()}
        assert got == pytest.approx(dict(zip(ids.tolist(), w.sum(1) - 1.0, strict=True)), abs=1e-9)


def test_sums_of_distances(packed, tied):
    ids, _, d = tied
    got = {r.i: (r.n, r.total) for r in density.distance_sums(packed).collect()}
    want = {int(i): ((ids > i).sum(), pytest.approx(d[k, ids > i].sum(), abs=1e-7)) for k, i in enumerate(ids) if (ids > i).any()}
    assert got == want


def test_cutoffs_by_place_and_by_halving(packed, tied):
    d = tied[2]
    each = np.sort(d[np.triu_indices(len(d), 1)])
    # the smallest are zeros, more than are looked at
    for place in (0, 300, len(each) // 50, len(each) - 1):
        assert density.distance_at(packed, place, buckets=64, few=20) == pytest.approx(each[place], abs=1e-9)
    assert density.distance_at(packed, len(each)) is None
    lo, hi = each[0], each[-1]
    while not 0.01 <= (each < (lo + hi) / 2).mean() <= 0.02:
        lo, hi = ((lo + hi) / 2, hi) if (each < (lo + hi) / 2).mean() < 0.01 else (lo, (lo + hi) / 2)
    assert density.cutoff_bisected(packed) == pytest.approx((lo + hi) / 2, abs=1e-9)


def test_pairs_as_rows(spark):
    x = {3: [0.0, 0.0], 1: [3.0, 4.0], 7: [0.0, 0.0]}
    got = density.pair_distances(spark.createDataFrame(list(x.items()), "id long, x array<double>"), 1)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 5.0), (1, 7, 5.0), (3, 7, 0.0)]
