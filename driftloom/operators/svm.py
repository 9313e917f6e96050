"""Large-margin learners: a linear grid as baseline, and a transductive machine trained on sums.

The transductive machine keeps its weights on the driver, a vector as long as the features; each
evaluation of its objective is one pass over the rows, whose partial sums are added by the cluster.
A radial kernel is taken through a bounded basis of rows: a row's products with the basis, centred
on the unlabelled rows and whitened, are its features, so that only a matrix of rows x basis is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions import numeric
from driftloom.operators.frames import draw

#: Weight of the unlabelled rows in each round.
ANNEALING = (0.0, 1e-6, 1e-4, 0.01, 0.1, 0.5, 1.0)
_GAMMA, _S = 20.0, 3.0


def linear_grid(train: DataFrame, test: DataFrame, features: str, label: str, costs=(0.001, 0.01, 0.1, 1.0, 10.0, 100.0), rounds: int = 200) -> DataFrame:
    """(cost, error, objective): test error of a linear machine for each cost, and its mean hinge loss and penalty where the descent ended.

    Features are scaled to unit deviation, and the penalty is on the scaled weights.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    spark, out = train.sparkSession, []
    ready = lambda d: d.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"))
    fit, judge = ready(train).cache(), ready(test).cache()
    for cost in costs:
        model = LinearSVC(featuresCol="x", labelCol="y", regParam=1 / (2 * cost * max(1, fit.count())), maxIter=rounds).fit(fit)
        wrong = model.transform(judge).agg(F.avg((F.col("prediction") != F.col("y")).cast("double"))).first()[0]
        out.append((cost, wrong, float(model.summary().objectiveHistory[-1])))
    fit.unpersist()
    judge.unpersist()
    return spark.createDataFrame(out, "cost double, error double, objective double")


class KernelMap:
    """Features whose products are those of the radial kernel exp(-|a-b|^2 / (2 sigma^2)) between rows and a basis, centred.

    The origin is the mean, in the kernel's space, of a sample of unlabelled rows. Weights on these
    features are weights on the basis; their squared length is the norm of the function.
    """

    def __init__(self, basis: np.ndarray, sample: np.ndarray, sigma: float):
        self.basis, self.sample, self.sigma = basis, sample, sigma
        self.of_basis = self._kernel(sample, basis).mean(0) if len(sample) else np.zeros(len(basis))
        self.of_all = float(self._kernel(sample, sample).mean()) if len(sample) else 0.0
        values, vectors = np.linalg.eigh(self._centred(basis))
        some = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
        self.whiten = vectors[:, some] / np.sqrt(values[some])

    @classmethod
    def drawn(cls, rows: DataFrame, sigma: float, basis: int, sample: int, seed: int) -> KernelMap:
        """From (x, y): at most ``basis`` different rows and ``sample`` unlabelled ones, those of the smallest hashes; only they reach the driver."""
        def few(df: DataFrame, most: int) -> np.ndarray:
            got = df.where("x is not null").orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(most).collect()
            return np.array([r.x for r in got], float).reshape(len(got), -1)

        return cls(few(rows.select("x").distinct(), basis), few(rows.where("y is null").select("x"), sample), sigma)

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.exp(-np.maximum(d, 0.0) / (2 * self.sigma * self.sigma))

    def _centred(self, x: np.ndarray) -> np.ndarray:
        of_rows = self._kernel(x, self.sample).mean(1) if len(self.sample) else np.zeros(len(x))
        return self._kernel(x, self.basis) - of_rows[:, None] - self.of_basis[None, :] + self.of_all

    def __call__(self, x: np.ndarray, step: int = 1024) -> np.ndarray:
        parts = [self._centred(x[i : i + step]) @ self.whiten for i in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros((0, self.whiten.shape[1]))


def lbfgs(f, w: np.ndarray, rounds: int, memory: int = 10, still: float = 1e-5) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a halving line search; f gives value and gradient."""
    value, g = f(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d -= a * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        size = 1.0 if steps else 1 / max(1.0, float(np.abs(g).sum()))
        for _ in range(12):
            new = w - size * d
            v2, g2 = f(new)
            if v2 <= value - 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            break
        if (new - w) @ (g2 - g) > 1e-12:
            steps = [*steps[-memory + 1 :], (new - w, g2 - g)]
        w, value, g = new, v2, g2
        if np.abs(g).max() < still:
            break
    return w


def newton(f, w: np.ndarray, rounds: int, still: float) -> np.ndarray:
    """Newton's descent with the absolute curvature and a halving line search; f gives value, gradient and curvature."""
    value, g, h = f(w)
    for _ in range(rounds):
        if np.abs(g).max(initial=0.0) < still:
            break
        e, v = np.linalg.eigh(h)
        d = v @ ((v.T @ g) / np.maximum(np.abs(e), 1e-8))
        size = 1.0
        for _ in range(30):
            v2, g2, h2 = f(w - size * d)
            if v2 <= value - 1e-4 * size * (g @ d) + 1e-15 * abs(value):
                break
            size /= 2
        else:
            break
        w, value, g, h = w - size * d, v2, g2, h2
    return w


class _Sparse:
    """Rows given as maps from feature to value."""

    def __init__(self, maps, width: int):
        entries = [dict(m) if m is not None else {} for m in maps]
        self.rows, self.width = len(entries), width
        self.row = np.repeat(np.arange(len(entries)), [len(m) for m in entries])
        self.at = np.array([k for m in entries for k in m], np.int64)
        self.value = np.array([v for m in entries for v in m.values()], float)
        known = (self.at >= 0) & (self.at < width)  # a feature that was not learned has no weight
        self.row, self.at, self.value = self.row[known], self.at[known], self.value[known]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], minlength=self.rows)

    def weighted(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * v[self.row], minlength=self.width)

    def curved(self, v: np.ndarray) -> np.ndarray:
        x = np.zeros((self.rows, self.width))
        x[self.row, self.at] = self.value
        return (x.T * v) @ x


class _Dense:
    def __init__(self, x: np.ndarray):
        self.x = x

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def weighted(self, v: np.ndarray) -> np.ndarray:
        return v @ self.x

    def curved(self, v: np.ndarray) -> np.ndarray:
        return (self.x.T * v) @ self.x


class TransductiveSVM:
    """Labels in {0, 1}, null where unknown; learns from both kinds of rows.

    Features are an array, or a map from feature number to value, which stays sparse (linear
    kernel only). A null label is an unlabelled row. The weight of the unlabelled rows grows in
    steps; each descends until no component of the gradient is above ``still``, at most ``rounds``
    times. Up to ``CURVED`` features it descends by curvature, with more by its recent steps. The
    radial kernel takes a basis of at most ``width`` rows and is centred on at most 1000 unlabelled ones.
    """

    CURVED = 512

    def __init__(self, lam: float = 1e-3, lam_u: float = 1.0, kernel: str = "linear", sigma: float = 1.0, width: int = 200, rounds: int = 200, still: float = 1e-9, seed: int = 1):
        self.lam, self.lam_u, self.kernel, self.sigma, self.width, self.rounds, self.still, self.seed = lam, lam_u, kernel, sigma, width, rounds, still, seed
        self.w, self.offset, self.platt, self.map = np.zeros(0), 0.0, (1.0, 0.0), None

    def _rows(self, column: pd.Series):
        if len(column) and not isinstance(column.iloc[0], (list, np.ndarray)):
            return _Sparse(column, len(self.w))
        return _Dense(np.array(column.tolist(), float).reshape(len(column), -1))

    def _sums(self, rows: DataFrame, w: np.ndarray, share: float, curved: bool):
        """Objective, gradient and, if ``curved``, curvature at ``w``: one pass."""
        made, b, p = self._rows, self.offset, len(w)

        def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((2, 2 + p + p * p * curved))
            for pdf in pdfs:
                if not len(pdf):
                    continue
                x = made(pdf["x"])
                y, f = pdf["y"].to_numpy(float), x.dot(w) + b
                seen = ~np.isnan(y)
                pull, bend = np.zeros((2, len(y))), np.zeros((2, len(y)))
                s = 2 * y[seen] - 1
                m = _GAMMA * (1 - s * f[seen])
                soft = np.where(m > 500, m, np.log1p(np.exp(np.minimum(m, 500)))) / _GAMMA
                half = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                e = np.exp(-_S * f[~seen] ** 2)
                pull[0, seen], pull[1, ~seen] = -s * half, -2 * _S * f[~seen] * e
                bend[0, seen], bend[1, ~seen] = _GAMMA * half * (1 - half), (4 * _S * _S * f[~seen] ** 2 - 2 * _S) * e
                sums = ((seen.sum(), soft.sum()), ((~seen).sum(), e.sum()))
                for k in (0, 1):
                    out[k] += np.concatenate((sums[k], x.weighted(pull[k]), x.curved(bend[k]).ravel() if curved else []))
            yield pd.DataFrame({"k": [0, 1], "v": out.tolist()})

        parts = rows.mapInPandas(work, "k int, v array<double>").select("k", F.posexplode("v").alias("i", "x"))
        r = parts.groupBy("k", "i").agg(F.sum("x").alias("x")).toPandas().pivot(index="k", columns="i", values="x").to_numpy()
        (l, lv), (u, uv) = r[0, :2], r[1, :2]
        l, u = max(l, 1), max(u, 1)
        both = r[0, 2:] / l + share * self.lam_u * r[1, 2:] / u
        value, g = lv / l + share * self.lam_u * uv / u + self.lam * (w @ w), both[:p] + 2 * self.lam * w
        return (value, g, both[p:].reshape(p, p) + 2 * self.lam * np.eye(p)) if curved else (value, g)

    def fit(self, df: DataFrame, features: str, label: str) -> TransductiveSVM:
        sparse = df.schema[features].dataType.typeName() == "map"
        if sparse and self.kernel != "linear":
            raise ValueError("sparse features take the linear kernel")
        rows = df.select(F.col(features).cast("map<int,double>" if sparse else "array<double>").alias("x"), F.col(label).cast("double").alias("y")).cache()
        self.offset = float(rows.agg(F.avg(2 * F.col("y") - 1)).first()[0] or 0.0)
        seen = rows
        if self.kernel == "rbf":
            self.map = KernelMap.drawn(rows, self.sigma, self.width, 1000, self.seed)
            seen = rows.select(self._mapped()(F.col("x")).alias("x"), "y").cache()
        wide = rows.agg(F.max(F.array_max(F.map_keys("x")) + 1) if sparse else F.max(F.size("x"))).first()[0] or 0
        self.w = np.zeros(self.map.whiten.shape[1] if self.map else wide)
        curved = len(self.w) <= self.CURVED
        for share in ANNEALING:
            f = lambda w, s=share: self._sums(seen, w, s, curved)
            self.w = newton(f, self.w, self.rounds, self.still) if curved else lbfgs(f, self.w, self.rounds, still=self.still)
        scored = self.decision(rows.where("y is not null"), "x").cache()
        self.platt = self._platt(scored)
        for held in (scored, seen, rows):
            held.unpersist()
        return self

    def _mapped(self):
        kernel = self.map

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(kernel(np.array(x.tolist(), float).reshape(len(x), -1))))

        return mapped

    def _platt(self, scored: DataFrame) -> tuple[float, float]:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        if scored.select("y").distinct().count() < 2:
            return 1.0, 0.0
        m = LogisticRegression(featuresCol="v", labelCol="y", maxIter=20).fit(scored.select(array_to_vector(F.array("score")).alias("v"), "y"))
        return float(m.coefficients[0]), float(m.intercept)

    def decision(self, df: DataFrame, features: str) -> DataFrame:
        """``df`` with score, the signed distance."""
        w, b, made = self.w, self.offset, self._rows

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(made(x).dot(w) + b if len(x) else [], dtype=float)

        kind = "map<int,double>" if df.schema[features].dataType.typeName() == "map" else "array<double>"
        x = F.col(features).cast(kind)
        return df.withColumn("score", score(self._mapped()(x) if self.map else x))

    def predict(self, df: DataFrame, features: str) -> DataFrame:
        """``df`` with score, label (a score of 0 counts as 1) and probability."""
        a, b = self.platt
        return self.decision(df, features).withColumn("predicted", (F.col("score") >= 0).cast("int")).withColumn("probability", 1 / (1 + F.exp(-(a * F.col("score") + b))))


def correlation(df: DataFrame, features: str) -> np.ndarray:
    """The correlation matrix of an array column: sums of products by batch, added by the cluster; the driver sees features x features."""
    rows = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"))

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                x = np.array(pdf["x"].tolist(), float)
                x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
                yield pd.DataFrame({"i": range(x.shape[1]), "v": (x.T @ x).tolist()})

    cells = rows.mapInPandas(work, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "s"))
    m = cells.groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas().pivot(index="i", columns="j", values="s").to_numpy()
    mean = m[0, 1:] / m[0, 0]
    c = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
    d = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1.0))
    return c / np.outer(d, d)


def grassmann(a: np.ndarray, b: np.ndarray, rank: int) -> tuple[float, float]:
    """Distance of the leading subspaces of two symmetric matrices by principal angles, and the gap of their singular values."""
    (ua, sa, _), (ub, sb, _) = np.linalg.svd(a), np.linalg.svd(b)
    angles = np.arccos(np.clip(np.linalg.svd(ua[:, :rank].T @ ub[:, :rank], compute_uv=False), -1, 1))
    return float(np.sqrt((angles**2).sum())), float(np.linalg.norm(sa[:rank] - sb[:rank]))


def random_correlation(width: int = 18, seed: int = 1) -> np.ndarray:
    w = np.random.default_rng(seed).standard_normal((width, width))
    c = w @ w.T
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def random_correlation_rows(spark, width: int, seed: int = 1) -> DataFrame:
    """(i, j, rho): a random correlation matrix as rows, products of normal draws that depend on their place alone; no side is gathered."""
    u = (draw(F.col("i"), F.col("k"), seed) + 1.0) / 2147483648.0
    grid = spark.range(width).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    w = grid.select("i", "k", u.alias("u")).select("i", "k", numeric.col(numeric.norm_ppf("u")).alias("w"))
    other = w.select(F.col("i").alias("j"), "k", F.col("w").alias("v"))
    c = w.join(other, "k").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("v")).alias("c"))
    d = c.where("i = j").select("i", F.sqrt("c").alias("d"))
    scaled = c.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
    return scaled.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("c") / (F.col("d") * F.col("e"))).alias("rho"))
