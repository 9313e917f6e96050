import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import numeric as n
from driftloom.operators import clusters, copula, density, frames, online, order, svm, trees
from driftloom.plans.tables import FEATURES, masked_long, matrix
from driftloom.sources import readers
from driftloom.streaming import copula_batches, online_learner, ring_window

SF = "/root/testdata/sf0.001"


def test_normal_functions(spark):
    d = NormalDist()
    df = spark.createDataFrame([(p,) for p in (1e-12, 1e-4, 0.2, 0.5, 0.93, 1 - 1e-9)], "p double")
    for r in df.select("p", n.col(n.norm_ppf("p")).alias("z"), n.col(n.norm_cdf(n.norm_ppf("p"))).alias("q")).collect():
        assert r.z == pytest.approx(d.inv_cdf(r.p), abs=1e-7) and r.q == pytest.approx(r.p, abs=1e-12)
    assert df.select(n.col(n.norm_ppf("p * 0")).alias("z")).first().z is None


@pytest.mark.parametrize("every", [2, 3, 4])
def test_interleaving_is_a_bijection(spark, every):
    for majors, minors in ((10, 3), (10, 5), (7, 9), (10, 1), (4, 0), (0, 3)):
        rows = [(0, i, majors, minors) for i in range(majors)] + [(1, i, majors, minors) for i in range(minors)]
        df = spark.createDataFrame(rows, "label int, rank int, majors int, minors int")
        places = [r[0] for r in df.select(frames.interleaved(F.col("label"), F.col("rank"), F.col("majors"), F.col("minors"), every)).collect()]
        assert sorted(places) == list(range(majors + minors))


def test_long_stream_keeps_its_state_between_batches(spark):
    """A key whose rows span Arrow batches, beside short ones and a null key, against one walk."""
    r = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else "hot" if i % 5 else f"k{i % 7}", i, [1.0, float(a)][: 1 + (i > 40)], None if i % 3 == 0 else int(a > 0)) for i, a in enumerate(r.standard_normal(30_000))]
    df = spark.createDataFrame(rows, "k string, i long, x array<double>, y int")
    got = {x.row_id: x for x in online.replay(df, "k", "i", "x", "y", schedule=4, blend=0.02, drift=True).collect()}
    assert len(got) == len(rows)
    states = {x.key: x.state for x in online.learned(df, "k", "i", "x", "y", schedule=4, blend=0.02, drift=True).collect()}
    for key in {x[0] for x in rows}:
        want, state = online.ftrl_rows([(i, x, y) for k, i, x, y in rows if k == key], schedule=4, blend=0.02, drift=True)
        assert all((g := got[o]).p == p and g.loss == loss and g.decay == decay and g.score == score for o, score, p, loss, decay in want)
        assert states[key].z == state["z"] and states[key].t == state["t"]


def test_scores_of_certain_rows(spark):
    """A probability that rounds to one does not end the ensemble."""
    df = spark.createDataFrame([(i, [500.0 * (1 if i % 2 else -1)], i % 2) for i in range(40)], "i long, x array<double>, y int").withColumn("k", F.lit(1))
    one = online.replay(df, "k", "i", "x", "y")
    assert one.where("p = 1").count() and online.ensemble(one, one).where("p is null").count() == 0


def test_ragged_rows_and_missing_labels():
    rows = [(0, [1.0], 1.0), (1, [1.0, 2.0], 0.0), (2, [1.0, None], None), (3, [1.0, 0.5], 1.0)]
    out, state = online.ftrl_rows(rows)
    assert out[2][3] is None and state["t"] == 3 and len(state["z"]) == 2


def test_expectation_against_numpy():
    sigma = np.array([[1, 0.6, 0.2], [0.6, 1, 0.4], [0.2, 0.4, 1.0]])
    nan = np.nan
    none = np.full((1, 3), nan)
    (x,), c = copula.expect_rows(np.array([[0.5, nan, -1.0]]), none, none, sigma)
    j = np.linalg.solve(sigma[np.ix_([0, 2], [0, 2])], sigma[[0, 2], 1])
    assert x[1] == pytest.approx(j @ [0.5, -1.0]) and c[1, 1] == pytest.approx(1 - j @ sigma[[0, 2], 1])
    (x,), c = copula.expect_rows(np.array([[0.5, 0.1, nan]]), np.array([[nan, 0.0, nan]]), none, sigma)
    assert x[1] > 0 and c[1, 1] > 0


def test_expectation_of_a_block_is_that_of_its_rows():
    r = np.random.default_rng(8)
    w = r.standard_normal((4, 4))
    sigma = copula.to_correlation(w @ w.T)
    z = np.where(r.uniform(size=(60, 4)) < 0.3, np.nan, r.standard_normal((60, 4)))
    lo, hi = (np.where(np.isnan(z) | (np.arange(4) < 2), np.nan, z + d) for d in (-0.4, 0.3))
    lo[::7] = np.nan  # open below
    x, c = copula.expect_rows(z, lo, hi, sigma)
    alone = [copula.expect_rows(z[i : i + 1], lo[i : i + 1], hi[i : i + 1], sigma) for i in range(60)]
    assert np.allclose(x, np.concatenate([a for a, _ in alone])) and np.allclose(c, sum(b for _, b in alone))
    # a cut normal variable against its integral
    m, t = copula._truncated(np.array([0.3]), 1.2, np.array([-0.5]), np.array([1.0]))
    g = np.linspace(-0.5, 1.0, 200_001)
    p = np.exp(-(((g - 0.3) / 1.2) ** 2) / 2)
    assert m[0] == pytest.approx((g * p).sum() / p.sum(), abs=1e-4) and t[0] == pytest.approx(((g - m[0]) ** 2 * p).sum() / p.sum(), abs=1e-4)


def test_copula_recovers_a_correlation(spark):
    r = np.random.default_rng(0)
    x = r.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 600)
    rows = [(i, k, None if (i + k) % 5 == 0 else float(np.exp(x[i, k]))) for i in range(600) for k in (0, 1)]
    cells = spark.createDataFrame(rows, "row_id long, feature_id int, value double")
    sigma = copula.fit(copula.rows_of(copula.latent(cells, []), 2), 2, 10)
    assert sigma[0, 1] == pytest.approx(0.8, abs=0.06) and np.allclose(np.diag(sigma), 1)
    done = copula.impute(cells, [], 2, sigma)
    assert done.count() == 1200 and done.where("value is null").count() == 0
    p = copula.change_test(spark, sigma, np.array([[1, -0.5], [-0.5, 1]]), 200, 40)
    assert max(p) < 0.05


def test_splits_against_brute_force(spark):
    m = matrix(spark, SF)
    cells = frames.to_long(m, "row_id", FEATURES[:1]).join(m.select("row_id", "label"), "row_id")
    best = trees.best_splits(trees.numeric_splits(trees.class_counts(cells, []), []), []).first()
    rows = [(r.f0, r.label) for r in m.select("f0", "label").collect()]
    values = sorted({v for v, _ in rows})

    def g(cut):
        out = 0.0
        for part in ([y for v, y in rows if v <= cut], [y for v, y in rows if v > cut]):
            q = sum(part) / len(part)
            out += len(part) / len(rows) * (1 - q * q - (1 - q) ** 2)
        return out

    assert best.g == pytest.approx(min(g((a + b) / 2) for a, b in zip(values, values[1:], strict=False)))


def test_tree_learns_a_step(spark):
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    df = df.withColumn("label", (F.col("a") > 11).cast("int"))
    tree = trees.grow(df, ["a", "b"])
    assert df.where(trees.predict(tree, ["a", "b"]) != F.col("label")).count() == 0
    trees.reset_drifted(tree, {1})
    assert trees.describe(tree) == [(1, None, None, 0)]


def test_seeded_clusters_and_drift(spark):
    rows = [(i, ["x", "y", "z"] if i % 2 else ["p", "q", "r"], i % 2 if i < 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, x array<string>, label int")
    done = clusters.repair_labels(clusters.k_modes(df, clusters.seeds(df))[0])
    assert done.where("repaired != row_id % 2").count() == 0
    m = clusters.modes(done)
    assert clusters.cluster_set_distance(m, m).first()[0] == 0
    assert clusters.drifted(0.5, 0.2, 0.3) and not clusters.drifted(0.4, 0.2, 0.3)


def test_cluster_count_by_value():
    """The rule as surveyed finds no change even where there is a gap; peak_count holds every step of it against SQL."""
    assert density.cluster_count(sorted(0.01 * (1 + i % 7) for i in range(26)) + [1.0, 1.1, 1.2, 1.3]) == 1
    assert density.cluster_count([0.5] * 30) == 1


def test_transductive_machine(spark):
    r = np.random.default_rng(5)
    y = r.integers(0, 2, 300)
    x = r.standard_normal((300, 5)) * 0.7 + (2 * y[:, None] - 1)
    rows = [(i, x[i].tolist(), int(y[i]) if i % 10 == 0 else None, int(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, known int, y int")
    for kernel in ("linear", "rbf"):
        out = svm.TransductiveSVM(kernel=kernel, sigma=3.0, rounds=2).fit(df, "x", "known").predict(df, "x")
        assert out.agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0] > 0.9
        assert out.where("probability < 0 or probability > 1").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1.5 nan -2\n0 3e-1 nan\n")
    assert [r.features for r in readers.read_matrix(spark, str(tmp_path / "m.txt"), 3, absolute=True).collect()] == [[1.5, None, 2.0], [0.0, 0.3, None]]
    assert [r.x for r in spark.createDataFrame([("[1.0, nan, 2]",), ("[]",)], "s string").select(readers.parse_ragged(F.col("s")).alias("x")).collect()] == [[1.0, 0.0, 2.0], []]
    readers.write_series(spark.createDataFrame([(2, 0.5), (1, 0.25)], "o int, v double"), str(tmp_path / "s"), "v", "o")
    assert sorted(r.value for r in readers.read_vector(spark, str(tmp_path / "s")).collect()) == [0.25, 0.5]
    (tmp_path / "h.csv").write_text("a;b\n1;-2\n;nan\n")
    assert [r.features for r in readers.read_matrix(spark, str(tmp_path / "h.csv"), 2, sep=";", header=True).collect()] == [[1.0, -2.0], [None, None]]
    wide = spark.createDataFrame([(2, [1.0, None]), (1, [3.5])], "o int, v array<double>")
    readers.write_ragged(wide, str(tmp_path / "r"), "v", "o")
    assert sorted(r.features for r in readers.read_ragged(spark, str(tmp_path / "r")).collect()) == [[1.0, 0.0], [3.5]]
    readers.write_csv(spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double"), str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), header=True, schema="a int, b double").collect())) == [(1, None), (2, 0.5)]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    m = matrix(spark, SF).select("user_id", "row_id", "label", F.lit(1.0).alias("one"), (F.col("f0") / 100).alias("a"))
    for k in range(3):
        m.where(F.floor(F.col("row_id") / 400) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_learner(stream, "user_id", "row_id", ["one", "a"], "label", schedule=3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == m.count()
    # files come in the order they were written, so every key's rows arrive in order
    want = online.replay(m, "user_id", "row_id", ["one", "a"], "label", schedule=3)
    both = got.join(want.select("row_id", F.col("p").alias("p2")), "row_id")
    assert both.where(F.abs(F.col("p") - F.col("p2")) > 1e-9).count() == 0
    ring = ring_window(stream, "user_id", "row_id", "a", 5).writeStream.format("memory").queryName("ring").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    ring.awaitTermination(120)
    assert spark.table("ring").where(F.size("values") > 5).count() == 0


def test_copula_stream_goes_on_after_a_restart(spark, tmp_path):
    cells = masked_long(spark, SF)
    parts = [cells.where(F.floor(F.col("row_id") / 200) == k) for k in range(3)]
    sigma = np.eye(4)
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "in"))
        copula_batches(stream, 4, [2, 3], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
        d = copula.batch_decay(k + 1, True)
        sigma = d * copula.moments(copula.rows_of(copula.latent(part, [2, 3]), 4), sigma) + (1 - d) * sigma
    done = spark.read.parquet(str(tmp_path / "out" / "rows"))
    assert done.count() == 2400 and done.where("value is null").count() == 0
    last = [r.row for r in spark.read.parquet(str(tmp_path / "out" / "matrix" / "batch=2")).orderBy("i").collect()]
    assert np.allclose(last, sigma)


def test_sparse_machine_agrees_with_the_dense_one(spark):
    r = np.random.default_rng(6)
    y = r.integers(0, 2, 200)
    x = np.where(r.uniform(size=(200, 6)) < 0.5, 0.0, r.standard_normal((200, 6)) + (2 * y[:, None] - 1))
    rows = [(i, v.tolist(), {k: float(a) for k, a in enumerate(v) if a}, int(y[i]) if i % 5 == 0 else None, int(y[i])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, s map<int,double>, known int, y int")
    dense, sparse = svm.TransductiveSVM(rounds=2).fit(df, "x", "known"), svm.TransductiveSVM(rounds=2).fit(df, "s", "known")
    assert np.allclose(dense.w, sparse.w, atol=1e-6)
    a, b = (m.predict(df, c).orderBy("id").toPandas() for m, c in ((dense, "x"), (sparse, "s")))
    assert np.allclose(a["score"], b["score"], atol=1e-6) and (a["predicted"] == b["predicted"]).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_places_sums_and_quantiles(spark, parts):
    """Against sorting each key's rows, with ties, nulls, a key of one row and a hot one."""
    r = np.random.default_rng(7)
    rows = [(0 if i % 10 else i % 3 + 1, None if i % 17 == 0 else float(r.integers(0, 40)), i) for i in range(2000)] + [(9, 1.5, 5000), (8, None, 5001)]
    df = spark.createDataFrame(rows, "k int, v double, i long").repartition(parts)
    seen = {k: sorted((v, i) for k2, v, i in rows if k2 == k and v is not None) for k in {x[0] for x in rows}}
    placed = order.placed(df.where("v is not null"), "k", ["v", "i"]).collect()
    assert len(placed) == sum(map(len, seen.values()))
    assert all(seen[x.k][x.place] == (x.v, x.i) and x.total == len(seen[x.k]) for x in placed)
    counts = df.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    for x in order.cumulative(counts, "k", "v", "n").collect():
        assert x.upto == sum(v <= x.v for v, _ in seen[x.k]) and x.total == len(seen[x.k])
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {x.k: x.q for x in order.quantiles(df, "k", "v", shares).collect()}
    assert got.keys() == {k for k, v in seen.items() if v}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile([v for v, _ in seen[k]], shares))


def test_value_at_a_place(spark):
    values = np.random.default_rng(1).exponential(1, 20_000).round(4).tolist()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "d double")
    for place in (0, 1, 777, 19_998, 19_999):
        assert order.value_at(df, "d", place, buckets=8, few=50) == sorted(values)[place]
    assert order.value_at(df, "d", 20_000) is None


def _stream(n, seed, flip=False):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, c = float(r.uniform(0, 100)), "xyz"[r.integers(0, 3)]
        y = int((a > 50) != flip)
        out.append((i, a, c, y if i % 3 else None))
    return out


def test_tree_grows_along_the_stream(spark):
    tree = trees.StreamTree("i", ["a"], ["c"], "y", width=50.0)
    rows = _stream(400, 1)
    for j in range(4):
        tree.update(spark.createDataFrame(rows[100 * j : 100 * j + 100], "i long, a double, c string, y int"))
    assert ("split", 1) in tree.log and tree.root.feature == 0 and tree.root.cut == pytest.approx(50, abs=5)
    away = spark.createDataFrame(_stream(300, 2), "i long, a double, c string, y int").where("y is not null")
    assert tree.predict(away).agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0] > 0.9


def test_tree_waits_for_rows(spark):
    tree = trees.StreamTree("i", ["a"], ["c"], "y", least=50)
    rows = _stream(60, 3)
    tree.update(spark.createDataFrame(rows[:30], "i long, a double, c string, y int"))
    assert tree.counts is None and tree.waiting.count() == 30
    tree.update(spark.createDataFrame(rows[30:], "i long, a double, c string, y int"))
    assert tree.waiting.count() == 0 and tree.counts.where("feature_id = 0").agg(F.sum("n0") + F.sum("n1")).first()[0] == 60


def test_drift_takes_a_split_back(spark):
    """Leaves that cannot be split keep clusters; rows of another kind make their parent a leaf again."""
    schema = "i long, a double, c string, d string, y int"
    near = [(i, 5.0 if i % 2 else 95.0, f"p{i * i % 23}", f"s{i * 7 % 29}", i % 2) for i in range(200)]
    far = [(1000 + i, 25.0 if i % 2 else 75.0, f"q{i * i % 23}", f"r{i * 7 % 29}", i % 2) for i in range(400)]
    tree = trees.StreamTree("i", ["a"], ["c", "d"], "y", width=1.0)
    for some in (near[:100], near[100:], far[:200], far[200:]):
        tree.update(spark.createDataFrame(some, schema))
    assert tree.log[0] == ("split", 1) and any(kind == "drift" for kind, _ in tree.log)


def test_categories_are_routed(spark):
    rows = [(i, "abcd"[i % 4], int(i % 4 in (1, 3))) for i in range(200)]
    tree = trees.StreamTree("i", [], ["c"], "y")
    for _ in range(2):  # until leaves have rows of their own they say what their parent says
        tree.update(spark.createDataFrame(rows, "i long, c string, y int"))
    assert sorted(tree.root.members) in (["a", "c"], ["b", "d"])
    assert tree.predict(spark.createDataFrame(rows, "i long, c string, y int")).where("predicted <> y").count() == 0


def test_spread_labels_reach_every_connected_point(spark):
    """A chain longer than any bound on hops, in two halves of which each has a label at one end."""
    n = 60
    rows = [(i, None if i == 0 else i - 1, [float(i >= n // 2), 1.0]) for i in range(n)]
    p = spark.createDataFrame(rows, "id long, parent long, x array<double>")
    labels = spark.createDataFrame([(n - 1, 1), (0, 0)], "id long, label int")
    got = {r.id: r for r in density.spread_labels(p, labels).collect()}
    assert got.keys() == set(range(n)) and all(got[i].label == int(i >= n // 2) for i in got)
    assert max(r.hops for r in got.values()) > 30


def test_correlation_of_arrays(spark):
    x = np.random.default_rng(3).standard_normal((500, 5)) @ np.random.default_rng(4).standard_normal((5, 5))
    got = svm.correlation(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v")
    assert np.allclose(got, np.corrcoef(x.T))


def test_imputing_along_a_stream_agrees_with_the_whole_column(spark):
    """One batch and a window of all rows: the same latents, matrix and inverses as the batch operators have."""
    long = masked_long(spark, SF)
    rows = matrix(spark, SF).select(F.lit(1).alias("s"), "row_id", frames.mask_pairs(F.array(*FEATURES), F.col("row_id")).alias("x"))
    got = {(r.row_id, r.k): r.v for r in copula.impute_stream(rows, "s", "row_id", "x", [2, 3], 10**6, 10**6).select("row_id", F.posexplode("values").alias("k", "v")).collect()}
    want = {(r.row_id, r.feature_id): r.value for r in copula.impute(long, [2, 3], 4, np.eye(4)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want if k[1] < 2)
    assert np.mean([got[k] == want[k] for k in want if k[1] > 1]) > 0.99  # a middle between two levels may fall to either


def test_imputing_along_a_stream_with_late_columns():
    r = np.random.default_rng(2)
    x = r.multivariate_normal([0, 0, 0], [[1, 0.9, 0.8], [0.9, 1, 0.8], [0.8, 0.8, 1]], 1200)
    seen = np.where(r.uniform(size=x.shape) < 0.3, np.nan, x)
    state = copula.StreamState([], 300)
    done = [state.step(seen[a : a + 100, : 2 + (a >= 400)])[0] for a in range(0, 1200, 100)]
    assert done[0].shape == (100, 2) and done[-1].shape == (100, 3) and not np.isnan(done[-1]).any()
    assert state.sigma[0, 1] > 0.75 and state.sigma[0, 2] > 0.6 and all(len(w) == 300 for w in state.rings)
    gone = np.isnan(seen[1100:])
    assert np.abs(done[-1] - x[1100:])[gone].mean() < 0.8 * np.abs(x[1100:])[gone].mean()


def test_linear_grid_by_value(spark):
    """Separable rows are told apart at a high cost, and the lowest cost does no better."""
    r = np.random.default_rng(9)
    x = r.standard_normal((200, 4)) + 3 * (np.arange(200)[:, None] % 2)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, x array<double>, y int")
    got = {q.cost: q.error for q in svm.linear_grid(df.where("id < 140"), df.where("id >= 140"), "x", "y").collect()}
    assert len(got) == 6 and got[100.0] < 0.1 and all(e <= 0.5 for e in got.values())


def test_subspaces_by_value():
    a, b = np.diag([3.0, 2.0, 1.0, 0.1]), np.diag([0.1, 1.0, 2.0, 3.0])
    assert svm.grassmann(a, a, 2) == pytest.approx((0, 0), abs=1e-6)
    angle, gap = svm.grassmann(a, b, 2)
    assert angle == pytest.approx(np.sqrt(2) * np.pi / 2) and gap == pytest.approx(0)
