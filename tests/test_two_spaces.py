"""Both spaces of a stream, the trees in them and the learners over them, against plain replays row by row."""

import math
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import copula, frames, trees
from driftloom.plans import experiment
from driftloom.plans.tables import FEATURES, matrix

SMALL = "/root/testdata/sf0.001"
N = NormalDist()


class PlainStream:
    """Imputation along one stream, one row and cell at a time."""

    def __init__(self, ordinal, window):
        self.ordinal, self.window, self.seen, self.sigma, self.batches = ordinal, window, defaultdict(list), np.eye(0), 0

    def latent(self, k, v):
        ring = self.seen[k]
        n, below, upto = len(ring), sum(a < v for a in ring), sum(a <= v for a in ring)
        if not n:  # nothing to compare with: as if it were missing
            return None
        if k in self.ordinal:
            lo, hi = (-math.inf if not m else math.inf if m == n else N.inv_cdf(m / n) for m in (below, upto))
            return N.inv_cdf(min(max((below + upto) / 2 / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))), lo, hi
        return N.inv_cdf(max(upto / (n + 1), 1 / (n + 1))), None, None

    def row(self, z):
        """Latents of a row and their conditional covariance; z: (latent, lo, hi) or None by feature."""
        p = len(z)
        obs, mis = [k for k in range(p) if z[k]], [k for k in range(p) if not z[k]]
        inv = np.linalg.inv(self.sigma[np.ix_(obs, obs)]) if obs else np.zeros((0, 0))
        start = np.array([z[k][0] for k in obs])
        x, var = np.zeros(p), np.zeros(p)
        for i, k in enumerate(obs):
            x[k] = z[k][0]
            if z[k][1] is not None and len(obs) > 1:
                v = 1 / inv[i, i]
                mean, sd = start[i] - v * float(inv[i] @ start), math.sqrt(v)
                a, b = (z[k][1] - mean) / sd, (z[k][2] - mean) / sd
                mass = N.cdf(b) - N.cdf(a)
                if mass > 1e-12:
                    fa, fb = (0.0 if math.isinf(e) else N.pdf(e) for e in (a, b))
                    ta, tb = (0.0 if math.isinf(e) else e * f for e, f in ((a, fa), (b, fb)))
                    m = (fa - fb) / mass
                    x[k], var[k] = mean + sd * m, v * (1 + (ta - tb) / mass - m * m)
        c = np.diag(var)
        if mis:
            j = inv @ self.sigma[np.ix_(obs, mis)]
            x[mis] = x[obs] @ j
            d = np.diag(var[obs])
            c[np.ix_(mis, mis)] = self.sigma[np.ix_(mis, mis)] - j.T @ self.sigma[np.ix_(obs, mis)] + j.T @ d @ j
            c[np.ix_(mis, obs)] = j.T @ d
            c[np.ix_(obs, mis)] = d @ j
        return x, c

    def batch(self, rows):
        p = max(len(self.sigma), max(len(r) for r in rows))
        sigma = np.eye(p)
        sigma[: len(self.sigma), : len(self.sigma)] = self.sigma
        self.sigma = sigma
        for r in rows:
            for k, v in enumerate(r):
                if v is not None:
                    self.seen[k] = (self.seen[k] + [v])[-self.window :]
        done = [self.row([self.latent(k, r[k]) if k < len(r) and r[k] is not None else None for k in range(p)]) for r in rows]
        if len(rows) > 1:
            x = np.array([a for a, _ in done])
            cov = np.cov(x.T).reshape(p, p) + sum(c for _, c in done) / (len(rows) - 1)
            sd = np.sqrt(np.diag(cov))
            own = cov / np.outer(sd, sd)
        else:
            own = self.sigma
        self.batches += 1
        d = 8 / (self.batches + 8)
        self.sigma = d * own + (1 - d) * self.sigma
        values, latents = [], []
        for r, (x, _) in zip(rows, done, strict=True):
            out = []
            for k in range(p):
                ring = sorted(self.seen[k])
                if k < len(r) and r[k] is not None:
                    out.append(r[k])
                elif not ring:
                    out.append(None)
                elif k in self.ordinal:
                    out.append(ring[min(max(math.ceil(round((len(ring) + 1) * N.cdf(x[k]) - 1, 3)), 0), len(ring) - 1)])
                else:
                    out.append(float(np.quantile(ring, N.cdf(x[k]))))
            values.append(out)
            latents.append([float(x[k]) if self.seen[k] else None for k in range(p)])
        return values, latents


def plain_stream(rows, ordinal, window, size):
    state, out = PlainStream(ordinal, window), {}
    for a in range(0, len(rows), size):
        some = rows[a : a + size]
        for (i, _), v, z in zip(some, *state.batch([x for _, x in some]), strict=True):
            out[i] = (v, z)
    return out


def like(got, want):
    assert got.keys() == want.keys()
    for i, (v, z) in want.items():
        assert got[i][0] == pytest.approx(v, abs=1e-7) and got[i][1] == pytest.approx(z, abs=1e-7), i


def test_both_spaces_with_late_and_ordinal_columns(spark):
    r = np.random.default_rng(7)
    x = r.multivariate_normal([0] * 4, 0.6 + 0.4 * np.eye(4), 330)
    x[:, 2] = np.floor(2 * x[:, 2])
    gone = r.uniform(size=x.shape) < 0.35
    rows = [(i, [None if gone[i, k] else float(x[i, k]) for k in range(2 if i < 110 else 3 if i < 200 else 4)]) for i in range(330)]
    rows[5] = (5, [None, None])
    df = spark.createDataFrame([("s", i, v) for i, v in rows], "k string, i long, x array<double>").withColumn("more", F.col("i") * 2)
    got = copula.impute_stream(df, "k", "i", "x", [2], 60, 40, carry=("more",)).collect()
    assert all(g.more == 2 * g.row_id for g in got)
    like({g.row_id: (g["values"], g.latents) for g in got}, plain_stream(rows, {2}, 60, 40))


def test_query_of_both_spaces(spark):
    rows = matrix(spark, SMALL).select(F.col("user_id") % 4, "row_id", frames.mask_pairs(F.array(*FEATURES), F.col("row_id")).alias("x")).orderBy("row_id").collect()
    want = {}
    for s in range(4):
        want |= plain_stream([(i, x) for k, i, x in rows if k == s], {2, 3}, experiment.WINDOW, experiment.BATCH)
    got = {r.row_id: ([r[c] for c in experiment.X], [r[c] for c in experiment.Z]) for r in experiment.two_space_stream(spark, SMALL).collect()}
    like(got, want)


def modal(values):
    best = max(Counter(values).values())
    return min(v for v, n in Counter(values).items() if n == best)


class PlainTree:
    """The stream tree over rows (id, features, label) as dictionaries and lists."""

    def __init__(self, numeric, categories, width, least=20, sibling_rows=120):
        self.kinds, self.width, self.least, self.sibling_rows = [True] * numeric + [False] * categories, width, least, sibling_rows
        self.tests, self.labels, self.waiting, self.recent = {}, {1: 0}, [], defaultdict(list)
        self.counts, self.history, self.log = defaultdict(Counter), {}, []

    def leaf(self, x):
        k = 1
        while k in self.tests:
            f, test = self.tests[k]
            left = x[f] is None or (x[f] <= test if self.kinds[f] else self.text(x[f]) in test)
            k = 2 * k + (not left)
        return k

    def text(self, v):
        return v if isinstance(v, str) else str(float(v))

    def predict(self, x):
        return self.labels[self.leaf(x)]

    def discrete(self, x):
        return ["" if v is None else str(math.floor(v / self.width)) if n else self.text(v) for v, n in zip(x, self.kinds, strict=True)]

    def clustered(self, rows):
        """(cluster, mismatches, label told) of each row, and modes by cluster, for one leaf."""
        xs = [self.discrete(x) for _, x, _ in rows]
        named = sorted({y for _, _, y in rows if y is not None})
        centres = {c: min((i, d) for (i, _, y), d in zip(rows, xs, strict=True) if y == c)[1] for c in named} or {0: min((i, d) for (i, _, _), d in zip(rows, xs, strict=True))[1]}
        for _ in range(2):
            near = [min((sum(a != b for a, b in zip(d, x, strict=True)), c) for c, x in centres.items()) for d in xs]
            used = sorted({c for _, c in near})
            modes = {c: [modal([d[f] for d, (_, q) in zip(xs, near, strict=True) if q == c]) for f in range(len(self.kinds))] for c in used}
            centres = modes
        major = {c: [y for (_, _, y), (_, q) in zip(rows, near, strict=True) if q == c and y is not None] for c in used}
        told = [y if y is not None else (modal(major[c]) if major[c] else None) for (_, _, y), (_, c) in zip(rows, near, strict=True)]
        tight = np.mean([np.mean([1 - m / len(self.kinds) for m, q in near if q == c]) for c in used])
        return told, modes, tight

    def drifted(self, k, modes, tight):
        if k not in self.history:
            return False
        old, r = self.history[k]
        best = [max(np.mean([a == b for a, b in zip(m, o, strict=True)]) for o in old.values()) for m in modes.values()]
        return 1 - np.mean(best) >= r + tight

    def best(self, k):
        """(g, feature, test) of the best split of each feature, best first, with the rows' own impurity and number."""
        gini = lambda c: 1 - sum((n / sum(c)) ** 2 for n in c) if sum(c) else 0.0
        found, root, n = [], 0, 0
        for f, number in enumerate(self.kinds):
            cells = defaultdict(lambda: [0, 0])
            for (v, y), c in self.counts[k, f].items():
                cells[v][y] += c
            total = [sum(c[y] for c in cells.values()) for y in (0, 1)]
            if not sum(total):
                continue
            values, options = sorted(cells), []
            if number:
                tests = [((a + b) / 2, [v for v in values if v <= a]) for a, b in zip(values, values[1:], strict=False)]
            elif len(values) <= 10:
                tests = [(s, s) for m in range(1, 2 ** (len(values) - 1)) for s in [[v for i, v in enumerate(values) if m >> i & 1]]]
            else:
                tests = [([v], [v]) for v in values]
            for test, inside in tests:
                a = [sum(cells[v][y] for v in inside) for y in (0, 1)]
                b = [t - x for t, x in zip(total, a, strict=True)]
                options.append(((gini(a) * sum(a) + gini(b) * sum(b)) / sum(total), test))
            if options:
                found.append((min(options)[0], f, min(options)[1]))
                root, n = gini(total), sum(total)
        return sorted(found, key=lambda o: o[:2]), root, n

    def update(self, rows):
        for row in rows:
            k = self.leaf(row[1])
            self.recent[k] = (self.recent[k] + [row])[-self.sibling_rows :]
        at = defaultdict(list)
        for row in self.waiting + rows:
            at[self.leaf(row[1])].append(row)
        full = {k: v for k, v in at.items() if len(v) >= self.least}
        self.waiting = [r for k, v in at.items() if k not in full for r in v]
        if not full:
            return
        done = {k: self.clustered(v) for k, v in full.items()}
        for k, rows_ in full.items():
            for (_, x, _), y in zip(rows_, done[k][0], strict=True):
                for f, v in enumerate(x):
                    if y is not None and v is not None:
                        self.counts[k, f][v if self.kinds[f] else self.text(v), y] += 1
        split = set()
        for k in sorted(full):
            found, root, n = self.best(k)
            if not found or n < self.least:
                continue
            eps = math.sqrt(math.log(1000) / (2 * n))
            gap = (found[1][0] if len(found) > 1 else root) - found[0][0]
            if found[0][0] < root and (gap > eps or gap < eps < 0.5):
                self.tests[k] = found[0][1:]
                self.labels[2 * k] = self.labels[2 * k + 1] = self.labels[k]
                self.log.append(("split", k))
                split.add(k)
        rest = [k for k in sorted(full) if k not in split]
        away = [k for k in rest if self.drifted(k, *done[k][1:])]
        self.log += [("drift", k) for k in away]
        back = set()
        for k in away:
            s = k ^ 1
            if k > 1 and s not in self.tests and s in self.labels and s in self.history and len(self.recent[s]) >= self.sibling_rows:
                _, modes, tight = self.clustered(self.recent[s])
                if self.drifted(s, modes, tight):
                    back.add(k // 2)
        for k in rest:
            if k == 1 or k not in away:
                self.history[k] = done[k][1:]
        for b in sorted(back):
            below = lambda k, b=b: k >> (k.bit_length() - b.bit_length()) == b if k.bit_length() >= b.bit_length() else False
            self.tests = {k: v for k, v in self.tests.items() if not below(k)}
            self.labels = {k: v for k, v in self.labels.items() if not below(k) or k == b}
            self.history = {k: v for k, v in self.history.items() if not below(k)}
            self.counts = defaultdict(Counter, {(k, f): v for (k, f), v in self.counts.items() if not below(k)})
        self.log += [("back", k) for k in sorted(back)]
        for leaf in [k for k in self.labels if k not in self.tests]:
            k = leaf
            while k and not sum(self.counts[k, 0].values()):
                k //= 2
            if k:
                n = [sum(c for (_, y), c in self.counts[k, 0].items() if y == v) for v in (0, 1)]
                self.labels[leaf] = int(n[1] > n[0])
        self.recent = defaultdict(list, {k: v for k, v in self.recent.items() if k in self.labels and k not in self.tests})


@pytest.fixture(scope="module")
def spaces(spark):
    return experiment.both_spaces(spark, SMALL).orderBy("row_id").collect()


@pytest.fixture(scope="module")
def said(spaces):
    """(predicted_x, predicted_z) of every row by the plain trees."""
    size = max(r.row_id for r in spaces) // experiment.MICRO_BATCHES + 1
    x, z, out = PlainTree(2, 2, 10.0), PlainTree(4, 0, 0.2), {}
    for j in range(experiment.MICRO_BATCHES):
        some = [r for r in spaces if r.row_id // size == j]
        sides = [(x, experiment.X), (z, experiment.Z)]
        rows = [[(r.row_id, [r[c] for c in names], r.known) for r in some] for _, names in sides]
        for a, b in zip(*rows, strict=True):
            out[a[0]] = (x.predict(a[1]), z.predict(b[1]))
        x.update(rows[0]), z.update(rows[1])
    assert x.log and z.log
    return out


def test_labels_of_both_trees(spark, said):
    got = experiment.two_space_labels(spark, SMALL).collect()
    assert {r.row_id: (r.predicted_x, r.predicted_z) for r in got} == said
    assert all(r.predicted == max(r.predicted_x, r.predicted_z) for r in got) and len({v for v in said.values()}) > 2


def learner(rows):
    """(score, p, loss) of each (features, told, label) row of the online learner without regularisation."""
    v, h, z, r, t, out = [0.0] * 5, [0.0] * 5, [0.0] * 5, 1.0, 0, []
    for x, told in rows:
        w = [-a / r for a in z]
        s = sum(a * b for a, b in zip(w, x, strict=True))
        p = 1 / (1 + math.exp(-s)) if s > -700 else math.exp(s)
        out.append((s, p, None if told is None else max(s, 0) - told * s + math.log(1 + math.exp(-abs(s)))))
        if told is not None:
            t += 1
            d = t / (t + 1)
            v = [a + (p - told) * b for a, b in zip(v, x, strict=True)]
            h = [d * a + b for a, b in zip(h, w, strict=True)]
            z = [a - b for a, b in zip(v, h, strict=True)]
            r = 1 + d * r
    return out


def test_learners_over_both_spaces(spark, spaces, said):
    zero = lambda c: 0.0 if c is None else c
    want = {}
    for key in range(4):
        rows = [r for r in spaces if r.key == key]
        told = {"known": [r.known for r in rows]}
        for name, pick in (("predicted_x", lambda s: s[0]), ("predicted_z", lambda s: s[1]), ("predicted", max)):
            told[name] = [r.known if r.known is not None else pick(said[r.row_id]) for r in rows]
        seen = {"x": [[1.0, *map(zero, r.x)] for r in rows], "z": [[1.0, *(zero(r[c]) for c in experiment.Z)] for r in rows]}
        ran = {name: learner(list(zip(seen[space], told[c or "known"], strict=True))) for name, (space, c) in experiment.VARIANTS.items()}
        for name, (a, b) in {"xz_known": ("x_known", "z_known"), "xz_filled": ("x_filled", "z_filled")}.items():
            gap, out = 0.0, []
            for (sx, _, lx), (sz, _, lz) in zip(ran[a], ran[b], strict=True):
                lam = 1 / (1 + math.exp(0.001 * gap))
                s = lam * sx + (1 - lam) * sz
                out.append((s, 1 / (1 + math.exp(-s)) if s > -700 else math.exp(s), None))
                gap += 0.0 if lx is None else lx - lz
            ran[name] = out
        for name, out in ran.items():
            wrong = 0
            for i, (r, (_, p, _)) in enumerate(zip(rows, out, strict=True)):
                wrong += abs(r.label - p) > 0.5
                want[name, key, r.row_id] = (p, wrong / (i + 1))
    got = {(r.variant, r.key, r.row_id): (r.p, r.cer) for r in experiment.two_space_learners(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    far = [k for k in want if got[k] != pytest.approx(want[k], abs=1e-5)]
    assert not far, far[:5]


SCHEMA = "i long, a double, c string, y int"


def grown(spark, batches, **options):
    """The tree and the plain one after the same batches, which must agree after each."""
    tree, plain = trees.StreamTree("i", ["a"], ["c"], "y", width=1.0, **options), PlainTree(1, 1, 1.0, **options)
    for rows in batches:
        tree.update(spark.createDataFrame(rows, SCHEMA))
        plain.update([(i, [a, c], y) for i, a, c, y in rows])
        assert tree.log == plain.log
        assert {k: n for k, f, _, n in trees._all_nodes(tree.root) if f is None} == {k: n for k, n in plain.labels.items() if k not in plain.tests}
    return tree


def kind(side, colour, first, n):
    """Rows of one leaf whose labels say nothing beyond the side, with values of one colour."""
    return [(first + i, float(side + 7 * colour + i % 3), f"{side}/{colour}/{i // 3 % 3}", int(side > 50) if i % 4 else None) for i in range(n)]


@pytest.mark.parametrize("sibling_drifts", [True, False])
def test_sibling_decides_on_drift(spark, sibling_drifts):
    """Both sides have clusters; then the left drifts. The parent goes only if the right side's last rows drifted too."""
    start = [r for pair in zip(kind(0, 0, 0, 130), kind(100, 0, 1000, 130), strict=True) for r in pair]
    batches = [start, kind(0, 0, 2000, 40) + kind(100, 0, 2100, 40)]
    # too few to be looked at by themselves
    batches += [kind(100, 1 if sibling_drifts else 0, 3000, 15), kind(0, 1, 5000, 40)]
    tree = grown(spark, batches, sibling_rows=15)
    assert ("split", 1) in tree.log and ("drift", 2) in tree.log
    assert (("back", 1) in tree.log) == sibling_drifts and (tree.root.feature is None) == sibling_drifts


def test_sibling_with_few_rows_keeps_the_parent(spark):
    start = [r for pair in zip(kind(0, 0, 0, 130), kind(100, 0, 1000, 130), strict=True) for r in pair]
    tree = grown(spark, [start, kind(0, 0, 2000, 40) + kind(100, 0, 2100, 40), kind(100, 1, 3000, 15), kind(0, 1, 5000, 40)], sibling_rows=120)
    assert ("drift", 2) in tree.log and tree.root.feature is not None


def test_counts_by_leading_digits(spark):
    """Counts stay small whatever the numbers, and a cut is as exact as the digits; small whole numbers stay as they are."""
    r = np.random.default_rng(12)
    values = np.concatenate((r.uniform(-100, 100, 900), np.arange(-40.0, 60.0), [0.0]))
    rows = [(i, float(v), "c", int(v > 30.05)) for i, v in enumerate(r.permutation(values))]
    trees_ = {d: trees.StreamTree("i", ["a"], ["c"], "y", width=10.0, digits=d) for d in (None, 6)}
    for tree in trees_.values():
        for a in range(0, len(rows), 500):
            tree.update(spark.createDataFrame(rows[a : a + 500], SCHEMA))
    exact, rounded = trees_[None].root, trees_[6].root
    assert exact.feature == rounded.feature == 0 and rounded.cut == pytest.approx(exact.cut, rel=2.0**-5)
    tree = trees.StreamTree("i", ["a"], ["c"], "y", width=10.0, digits=6, delta=1e-300, tie=0.0)  # never split
    tree.update(spark.createDataFrame(rows, SCHEMA))
    kept = {float(c.value) for c in tree.counts.where("feature_id = 0").collect()}
    unit = lambda v: 2.0 ** (math.floor(math.log2(abs(v))) - 5)
    assert kept == {round(v / unit(v)) * unit(v) if v else 0.0 for v in values} and {float(v) for v in range(-40, 60)} <= kept
    assert len(kept) < 500 and tree.counts.where("feature_id = 0").agg(F.sum("n0") + F.sum("n1")).first()[0] == len(rows)
