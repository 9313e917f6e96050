"""Learners that label points along a pointer graph, and a graph that grows, against plain replays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_two_spaces import PlainTree, learner

from driftloom.operators import density, trees
from driftloom.plans import density as plans

SMALL = "/root/testdata/sf0.001"


def spread(parents, seeds, learn, tell):
    """{id: (label, hop)}: ``learn`` a list of (id, label), ``tell`` an id -> label or None; ids in order."""
    known, hop, news = {i: (y, 0) for i, y in seeds.items()}, 0, sorted(seeds.items())
    for back in (False, True):
        front, waiting, last = set(known), set(), False
        while True:
            reached = {c for c, p in parents.items() if p in front} if back else {parents[i] for i in front if parents.get(i) is not None}
            asked = sorted((reached | waiting) - set(known))
            if not asked:
                break
            hop += 1
            if news:
                learn(news)
            told = {i: tell(i, last) for i in asked}
            news = [(i, y) for i, y in told.items() if y is not None]
            last = not news
            front, waiting = {i for i, _ in news}, {i for i, y in told.items() if y is None}
            known |= {i: (y, hop) for i, y in news}
    return known


@pytest.fixture(scope="module")
def graph():
    """(points, parents, seeds): three clumps with ties and equal points, in one tree of pointers."""
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(120, 3)) + 4 * (np.arange(120)[:, None] % 3), 1)
    x[60:63] = x[3:6]
    parents = {i: None if i == 0 else int(r.integers(0, i)) for i in range(120)}
    return x, parents, {i: int(i % 3 == 1) for i in range(120) if i % 5 < 2}


def frames(spark, graph):
    x, parents, seeds = graph
    p = spark.createDataFrame([(i, parents[i], v.tolist()) for i, v in enumerate(x)], "id long, parent long, x array<double>")
    return p, spark.createDataFrame(list(seeds.items()), "id long, label int")


def rows(df):
    got = {r.id: (r.label, r.hops) for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_labelled_points(spark, graph, k):
    x, parents, seeds = graph
    known = {}

    def tell(i, last):
        near = sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in known)[:k]
        some = near[0][0] == 0
        votes = {}
        for d, j in near:
            votes[known[j]] = votes.get(known[j], 0.0) + (float(d == 0) if some else 1 / d)
        return min(votes, key=lambda y: (-votes[y], y))

    want = spread(parents, seeds, lambda new: known.update(new), tell)
    p, labels = frames(spark, graph)
    assert rows(density.spread_labels(p, labels, learner=density.NearestLearner(k, block_rows=16))) == want


@pytest.mark.parametrize("unsure", [0.0, 0.15])
def test_online_learner_goes_on_from_hop_to_hop(spark, graph, unsure):
    x, parents, seeds = graph
    seen = []

    def tell(i, last):
        p = learner4(seen + [([1.0, *x[i]], None)])[-1]
        return None if abs(p - 0.3) < unsure and not last else int(p >= 0.3)

    want = spread(parents, seeds, lambda new: seen.extend(([1.0, *x[i]], float(y)) for i, y in new), tell)
    p, labels = frames(spark, graph)
    got = rows(density.spread_labels(p, labels, learner=density.OnlineLearner(0.3, unsure)))
    assert got == want and set(got) == set(parents)
    if unsure:
        sure = rows(density.spread_labels(p, labels, learner=density.OnlineLearner(0.3)))
        assert max(h for _, h in got.values()) > max(h for _, h in sure.values())


def learner4(rows_):
    """Probabilities of the plain learner, whose rows have five features."""
    return [p for _, p, _ in learner([([*v, 0.0], y) for v, y in rows_])]


def test_tree_by_fronts(spark, graph):
    x, parents, seeds = graph
    plain = PlainTree(3, 0, 2.0)
    learn = lambda new: plain.update([(i, x[i].tolist(), y) for i, y in new])
    want = spread(parents, seeds, learn, lambda i, last: plain.predict(x[i].tolist()))
    tree = trees.StreamTree("id", ["a", "b", "c"], [], "y", width=2.0)
    p, labels = frames(spark, graph)
    assert rows(density.spread_labels(p, labels, learner=density.TreeLearner(tree))) == want
    assert tree.log == plain.log and ("split", 1) in tree.log


def whole(x, dc):
    """{id: (rho, delta, parent)} of all points."""
    d = np.array([[np.sqrt(((b - a) ** 2).sum()) for b in x.values()] for a in x.values()])
    ids = list(x)
    rho = {i: int((d[k] < dc).sum()) - 1 for k, i in enumerate(ids)}
    out = {}
    for k, i in enumerate(ids):
        up = [(d[k, m], j) for m, j in enumerate(ids) if (rho[j], -j) > (rho[i], -i)]
        out[i] = (float(rho[i]), *(min(up) if up else (d.max(), None)))
    return out


def test_growing_graph_is_the_whole_one_after_each_batch(spark):
    r = np.random.default_rng(1)
    x = {int(i): v for i, v in zip(r.permutation(160), np.round(r.normal(size=(160, 2)), 1), strict=True)}
    graph, ids, changed = density.PointerGraph(0.35, block_rows=24), list(x), []
    for a, b in ((0, 50), (50, 51), (51, 110), (110, 160)):
        changed.append(graph.add(spark.createDataFrame([(i, x[i].tolist()) for i in ids[a:b]], "id long, x array<double>")))
        got = {g.id: (g.rho, pytest.approx(g.delta, abs=1e-12), g.parent) for g in graph.points.collect()}
        assert got == whole({i: x[i] for i in ids[:b]}, 0.35)
    assert changed[0] == 0 and 0 < changed[1] < 50  # a single point moves only what is near


def test_queries_by_the_learners(spark):
    """The registered queries label every point, and the growing graph is the one over all points."""
    pts = {r.id: np.array(r.x) for r in plans._points(spark, SMALL).collect()}
    parents = {r.id: r.parent for r in plans.growing_graph(spark, SMALL).points.collect()}
    labels = {r.vec_id: r.label % 2 for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 10 = 0").collect()}
    state = [np.zeros(65), np.zeros(65), np.zeros(65), 1.0, 0]  # v, h, z, r, t

    def learn(new):
        for i, y in new:
            x = np.concatenate(([1.0], pts[i]))
            w = -state[2] / state[3]
            p = 1 / (1 + math.exp(-float(w @ x)))
            state[4] += 1
            d = state[4] / (state[4] + 1)
            state[0] += (p - y) * x
            state[1] = d * state[1] + w
            state[2] = state[0] - state[1]
            state[3] = 1 + d * state[3]

    want = spread(parents, labels, learn, lambda i, last: int(1 / (1 + math.exp(float(state[2] @ np.concatenate(([1.0], pts[i]))) / state[3])) >= 0.3))
    assert rows(plans.label_spreading_growing(spark, SMALL)) == want
    assert plans.label_spreading_online(spark, SMALL).agg(F.count("*"), F.countDistinct("id"), F.count("label")).first()[:] == (len(pts),) * 3
