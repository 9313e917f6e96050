"""Gaussian-copula imputation: marginals by rank, one correlation matrix, conditional means.

Cells stay long (row_id, feature_id, value): marginals are one shuffle by feature, and a feature
that appears late in the stream needs nothing. The correlation matrix is features x features, so
it travels in the plan; rows are handled in Arrow batches, with one solve for each pattern of
missing cells in a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftloom.functions import numeric as n
from driftloom.functions.arrays import norm_cdf, norm_ppf
from driftloom.operators import order
from driftloom.operators.lineage import cut, stored

#: Batches that one task takes in turn before the driver hands the matrix to the next task.
CHAIN = 200
#: Tasks that streams are dealt to.
STREAM_TASKS = 64


def ring(long: DataFrame, size: int) -> DataFrame:
    """The last ``size`` observed values of each feature, with slot (1: newest)."""
    w = Window.partitionBy("feature_id").orderBy(F.desc("row_id"))
    return long.where("value is not null").withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= size)


def ring_last_of_batch(long: DataFrame, batch: int, size: int) -> DataFrame:
    """The ring that only each batch's last row enters, after the first batch."""
    last = F.max("row_id").over(Window.partitionBy(F.floor(F.col("row_id") / batch)))
    kept = long.withColumn("_last", last).where((F.col("row_id") < batch) | (F.col("row_id") == F.col("_last")))
    return ring(kept.drop("_last"), size)


def ecdf(long: DataFrame) -> DataFrame:
    """(…, F, c): the share of a feature's observed values that are no larger, and how many are observed."""
    seen = long.where("value is not null")
    counts = order.cumulative(seen.groupBy("feature_id", "value").agg(F.count("*").alias("k")), "feature_id", "value", "k")
    return seen.join(counts.select("feature_id", "value", (F.col("upto") / F.col("total")).alias("F"), F.col("total").alias("c")), ["feature_id", "value"])


def continuous_latent(long: DataFrame) -> DataFrame:
    """(…, z): the normal quantile of a value's rank, kept inside (0, 1) by the number of values."""
    return ecdf(long).withColumn("z", n.col(n.norm_ppf("(F * c / (c + 1))"))).drop("c")


def ordinal_bounds(long: DataFrame) -> DataFrame:
    """(feature_id, value, lo, hi): the latent interval of each level; null where it is open."""
    counts = long.where("value is not null").groupBy("feature_id", "value").agg(F.count("*").alias("k"))
    w = Window.partitionBy("feature_id").orderBy("value")
    total = F.sum("k").over(Window.partitionBy("feature_id"))
    s = counts.select("feature_id", "value", ((F.sum("k").over(w) - F.col("k")) / total).alias("a"), (F.sum("k").over(w) / total).alias("b"))
    return s.select("feature_id", "value", n.col(n.norm_ppf("a")).alias("lo"), n.col(n.norm_ppf("b")).alias("hi"), n.col(n.norm_ppf("((a + b) / 2)")).alias("z"))


def latent(long: DataFrame, ordinal: list[int]) -> DataFrame:
    """(row_id, feature_id, z, lo, hi) for every cell: null z where the value is missing.

    An ordinal cell starts at the middle of its interval's mass, which needs no random draw.
    """
    cont = continuous_latent(long.where(~F.col("feature_id").isin(ordinal))).select("row_id", "feature_id", "z", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    levels = ordinal_bounds(long.where(F.col("feature_id").isin(ordinal)))
    ords = long.where(F.col("feature_id").isin(ordinal) & F.col("value").isNotNull()).join(levels, ["feature_id", "value"]).select("row_id", "feature_id", "z", "lo", "hi")
    gone = long.where("value is null").select("row_id", "feature_id", *(F.lit(None).cast("double").alias(c) for c in ("z", "lo", "hi")))
    return cont.unionByName(ords).unionByName(gone)


def rows_of(cells: DataFrame, width: int) -> DataFrame:
    """(row_id, z, lo, hi) as arrays of all features; features that a row lacks are null."""
    made = cells.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", F.struct("z", "lo", "hi")))).alias("m"))
    pick = lambda name: F.array(*(F.col("m")[i][name] for i in range(width)))
    return made.select("row_id", *(pick(x).alias(x) for x in ("z", "lo", "hi")))


def _truncated(mean: np.ndarray, sd: float, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of normal variables cut to intervals; NaN where next to nothing is left."""
    a, b = (lo - mean) / sd, (hi - mean) / sd
    mass = norm_cdf(b) - norm_cdf(a)
    near = [np.where(np.abs(x) < 1e6, x, 0.0) for x in (a, b)]
    pa, pb = (np.where(np.abs(x) < 1e6, np.exp(-y * y / 2) / math.sqrt(2 * math.pi), 0.0) for x, y in zip((a, b), near, strict=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (pa - pb) / mass
        t = 1 + (near[0] * pa - near[1] * pb) / mass - m * m
    gone = mass <= 1e-12
    return np.where(gone, np.nan, mean + sd * m), np.where(gone, np.nan, sd * sd * t)


def _patterns(seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each distinct row, in order, and where it is."""
    if seen.shape[1] > 62:
        for pattern in np.unique(seen, axis=0):
            yield pattern, np.flatnonzero((seen == pattern).all(1))
        return
    codes = seen @ (1 << np.arange(seen.shape[1] - 1, -1, -1))
    for code in np.unique(codes):
        at = np.flatnonzero(codes == code)
        yield seen[at[0]], at


def expect_rows(z: np.ndarray, lo: np.ndarray, hi: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The E-step of a block of rows: imputed latents, and the sum of their conditional covariances.

    Observed ordinals (those with a bound) move to the mean of their cut conditional law, then the
    missing cells to theirs. Rows are taken by their pattern of missing cells: one solve, and a few
    matrix products, for each.
    """
    x, c = z.copy(), np.zeros_like(sigma)
    seen = ~np.isnan(z)
    for pattern, at in _patterns(seen):
        obs, mis = np.flatnonzero(pattern), np.flatnonzero(~pattern)
        inv = np.linalg.inv(sigma[np.ix_(obs, obs)]) if len(obs) else np.zeros((0, 0))
        j = inv @ sigma[np.ix_(obs, mis)]
        told, var = z[np.ix_(at, obs)], np.zeros(len(obs))
        moved, pull = told.copy(), told @ inv
        for i, k in enumerate(obs if len(obs) > 1 else ()):
            some = np.flatnonzero(~(np.isnan(lo[at, k]) & np.isnan(hi[at, k])))
            if len(some):
                v = 1 / inv[i, i]
                ends = (np.where(np.isnan(e[at[some], k]), f, e[at[some], k]) for e, f in ((lo, -np.inf), (hi, np.inf)))
                m, t = _truncated(told[some, i] - v * pull[some, i], math.sqrt(v), *ends)
                moved[some, i] = np.where(np.isfinite(m), m, told[some, i])
                var[i] = t[np.isfinite(t)].sum()
        x[np.ix_(at, obs)] = moved
        x[np.ix_(at, mis)] = moved @ j
        c[obs, obs] += var
        c[np.ix_(mis, mis)] += len(at) * (sigma[np.ix_(mis, mis)] - j.T @ sigma[np.ix_(obs, mis)])
        if var.sum() > 0:
            k = j.T * var
            c[np.ix_(mis, obs)] += k
            c[np.ix_(obs, mis)] += k.T
            c[np.ix_(mis, mis)] += k @ j
    return x, c


def _arrays(pdf: pd.DataFrame, width: int) -> list[np.ndarray]:
    return [np.array(pdf[c].tolist(), float).reshape(-1, width) for c in ("z", "lo", "hi")]


def expectation(rows: DataFrame, sigma: np.ndarray) -> DataFrame:
    """(row_id, x): every row's latents with the missing ones at their conditional means."""

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                yield pd.DataFrame({"row_id": pdf["row_id"], "x": expect_rows(*_arrays(pdf, len(sigma)), sigma)[0].tolist()})

    return rows.mapInPandas(work, "row_id long, x array<double>")


def _add_rows(sums: tuple[int, np.ndarray, np.ndarray], pdf: pd.DataFrame, sigma: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and second moments of the imputed latents of all rows so far."""
    k, one, two = sums
    x, c = expect_rows(*_arrays(pdf, len(sigma)), sigma)
    return k + len(x), one + x.sum(0), two + x.T @ x + c


def _next_matrix(k: int, one: np.ndarray, two: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """The matrix that the sums give; fewer than two rows leave it."""
    if k < 2:
        return sigma
    mean = one / k
    return to_correlation((two - k * np.outer(mean, mean)) / (k - 1))


def _local_moments(pdf: pd.DataFrame, sigma: np.ndarray) -> np.ndarray:
    """:func:`moments` of the rows of one batch, inside a task."""
    return _next_matrix(*_add_rows((0, np.zeros(len(sigma)), np.zeros_like(sigma)), pdf, sigma), sigma)


def moments(rows: DataFrame, sigma: np.ndarray) -> np.ndarray:
    """The next correlation matrix: covariance of the imputed latents and the mean conditional covariance.

    Each task returns its sums, one row; the driver adds matrices of features x features.
    """
    p = len(sigma)

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = (0, np.zeros(p), np.zeros((p, p)))
        for pdf in pdfs:
            sums = _add_rows(sums, pdf, sigma)
        k, one, two = sums
        yield pd.DataFrame({"k": [k], "v": [np.concatenate((one, two.ravel())).tolist()]})

    parts = rows.mapInPandas(work, "k long, v array<double>").select("k", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("i").agg(F.sum("x").alias("x"), F.sum("k").alias("k")).toPandas().sort_values("i")
    if sums.empty:
        return sigma
    v = sums["x"].to_numpy()
    return _next_matrix(int(sums["k"].iloc[0]), v[:p], v[p:].reshape(p, p), sigma)


def to_correlation(c: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1.0))
    return c / np.outer(d, d) + np.diag((np.diag(c) <= 0).astype(float))


def scaled_difference(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.linalg.norm(a - b) / np.linalg.norm(a))


def batch_decay(j: int, changing: bool) -> float:
    return 8 / (j + 8) if changing else 0.5


def _until_still(step, width: int, most_rounds: int, least_change: float) -> np.ndarray:
    sigma = np.eye(width)
    for _ in range(most_rounds):
        new = step(sigma)
        if scaled_difference(sigma, new) < least_change:
            return new
        sigma = new
    return sigma


def fit(rows: DataFrame, width: int, most_rounds: int = 50, least_change: float = 0.01) -> np.ndarray:
    """Batch EM: rounds until the matrix changes by less than one part in a hundred."""
    return _until_still(lambda sigma: moments(rows, sigma), width, most_rounds, least_change)


def fit_batches(rows: DataFrame, width: int, size: int, count: int | None = None, changing: bool = True) -> np.ndarray:
    """Online EM: one step for each batch of ``size`` rows, blended with what came before.

    All batches up to the largest row_id, or the first ``count``. Each step needs the matrix of the
    one before, so tasks follow one another; each takes ``CHAIN`` batches and holds one at a time.
    """
    rows, sigma = stored(rows, "row_id"), np.eye(width)
    if count is None:
        last = rows.agg(F.max("row_id")).first()[0]
        count = 0 if last is None else last // size + 1

    def chained(sigma: np.ndarray):
        def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, sums, at = sigma, None, None

            def blended() -> np.ndarray:
                d = batch_decay(at + 1, changing)
                return d * _next_matrix(*sums, now) + (1 - d) * now

            for pdf in pdfs:
                for j, part in pdf.groupby(pdf["row_id"] // size):
                    if j != at:
                        now = blended() if sums else now
                        sums, at = (0, np.zeros(width), np.zeros((width, width))), int(j)
                    sums = _add_rows(sums, part, now)
            if sums:
                yield pd.DataFrame({"v": [blended().ravel().tolist()]})

        return work

    for a in range(0, count, CHAIN):
        some = rows.where(F.col("row_id").between(a * size, min(a + CHAIN, count) * size - 1)).coalesce(1).sortWithinPartitions("row_id")
        for r in some.mapInPandas(chained(sigma), "v array<double>").collect():
            sigma = np.array(r.v).reshape(width, width)
    return sigma


def fit_shares(rows: DataFrame, width: int, batches: int = 20, changing: bool = True) -> np.ndarray:
    """Online EM in ``batches`` equal shares of the range of row_id, however long the stream: each share's sums are added by the cluster.

    For streams whose batches are too large for one task; :func:`fit_batches` is for small ones.
    """
    rows, sigma = stored(rows, "row_id"), np.eye(width)
    low, high = rows.agg(F.min("row_id"), F.max("row_id")).first()
    if low is None:
        return sigma
    for j in range(batches):
        a, b = (low + (high + 1 - low) * k // batches for k in (j, j + 1))
        d = batch_decay(j + 1, changing)
        sigma = d * moments(rows.where((F.col("row_id") >= a) & (F.col("row_id") < b)), sigma) + (1 - d) * sigma
    return sigma


def widen(sigma: np.ndarray, width: int) -> np.ndarray:
    """For a trapezoid stream: new features are uncorrelated at first."""
    out = np.eye(width)
    out[: len(sigma), : len(sigma)] = sigma
    return out


def impute(long: DataFrame, ordinal: list[int], width: int, sigma: np.ndarray) -> DataFrame:
    """(row_id, feature_id, value): missing cells at the observed quantile of their latent mean.

    Continuous: linear between sorted values. Ordinal: the value at place ceil((n + 1) q - 1), as in
    the reference. Sorted values are numbered in ranges, by place in the range and the ranges before.
    """
    cells = latent(long, ordinal)
    x = expectation(rows_of(cells, width), sigma).select("row_id", F.posexplode("x").alias("feature_id", "z"))
    seen = order.placed(long.where("value is not null").select("feature_id", "value", "row_id"), "feature_id", ["value", "row_id"])
    seen = cut(seen.select("feature_id", "place", "value", "total"))
    sizes = seen.groupBy("feature_id").agg(F.first("total").alias("n"))
    gone = long.where("value is null").select("row_id", "feature_id").join(x, ["row_id", "feature_id"]).join(F.broadcast(sizes), "feature_id", "left")
    q, is_level = n.col(n.norm_cdf("z")), F.col("feature_id").isin(ordinal)
    at = F.when(is_level, F.greatest(F.ceil(F.round((F.col("n") + 1) * q - 1, 3)), F.lit(0))).otherwise(q * (F.col("n") - 1))
    gone = gone.withColumn("at", F.least(at.cast("double"), (F.col("n") - 1).cast("double"))).withColumn("low", F.floor("at"))
    gone = gone.withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    value_at = lambda c: seen.select("feature_id", F.col("place").alias(c), F.col("value").alias(f"{c}_value"))
    both = gone.join(value_at("low"), ["feature_id", "low"], "left").join(value_at("high"), ["feature_id", "high"], "left")
    filled = both.select("row_id", "feature_id", (F.col("low_value") + (F.col("high_value") - F.col("low_value")) * (F.col("at") - F.col("low"))).alias("value"))
    return long.where("value is not null").select("row_id", "feature_id", "value").unionByName(filled)


class StreamState:
    """What imputation along a stream knows: the last ``window`` observed values of each feature, and the latent correlations.

    Features may appear late: they start uncorrelated and without values. A batch first enters the
    windows, then its rows are made latent by them, the matrix moves, and missing cells are read
    back from the windows. A feature that was never seen stays missing, in both spaces.

    With ``samples``, each batch's own matrix is first tested against the one carried: as many
    pairs of samples are drawn from the carried one, of the batch's size and of the number of rows
    that the carried one is worth, and where next to none differs as much (a p-value of at most
    ``level``) the stream has changed: the batch's own matrix takes the place of the carried one,
    and the decay starts anew.
    """

    def __init__(self, ordinal: list[int], window: int, changing: bool = True, last_only: bool = False, samples: int = 0, level: float = 0.01, seed: int = 1):
        self.ordinal, self.window, self.changing, self.last_only = set(ordinal), window, changing, last_only
        self.samples, self.level, self.seed = samples, level, seed
        self.rings: list[np.ndarray] = []
        self.sigma, self.batches, self.since, self.spread = np.eye(0), 0, 0, 0.0
        self.p_change: float | None = None

    def _see(self, x: np.ndarray) -> None:
        """After the first batch, only the last row enters if ``last_only``."""
        for k in range(len(self.rings), x.shape[1]):
            self.rings.append(np.zeros(0))
        self.sigma = widen(self.sigma, len(self.rings))
        rows = x[-1:] if self.last_only and self.batches else x
        for k in range(x.shape[1]):
            seen = rows[:, k][~np.isnan(rows[:, k])]
            self.rings[k] = np.concatenate((self.rings[k], seen))[-self.window :]

    def _latent(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, lo, hi = (np.full(x.shape, np.nan) for _ in range(3))
        for k in range(x.shape[1]):
            ring, at = np.sort(self.rings[k]), np.flatnonzero(~np.isnan(x[:, k]))
            n, v = len(ring), x[at, k]
            if not n or not len(at):
                continue
            upto, below = np.searchsorted(ring, v, "right") / n, np.searchsorted(ring, v, "left") / n
            if k in self.ordinal:
                lo[at, k], hi[at, k] = norm_ppf(below, -np.inf, np.inf), norm_ppf(upto, -np.inf, np.inf)
                z[at, k] = norm_ppf(np.clip((below + upto) / 2, 0.5 / (n + 1), 1 - 0.5 / (n + 1)))
            else:
                z[at, k] = norm_ppf(np.clip(upto * n / (n + 1), 1 / (n + 1), None))
        return z, lo, hi

    def _inverse(self, k: int, z: np.ndarray) -> np.ndarray:
        ring = np.sort(self.rings[k])
        if not len(ring):
            return np.full(len(z), np.nan)
        q = norm_cdf(z)
        if k in self.ordinal:
            at = np.ceil(np.round((len(ring) + 1) * q - 1, 3)).astype(int)
            return ring[np.clip(at, 0, len(ring) - 1)]
        return np.quantile(ring, q)

    def _moved(self, own: np.ndarray, rows: int) -> np.ndarray:
        """The matrix after a batch whose own one is ``own``."""
        self.batches += 1
        self.since += 1
        self.p_change = None
        if self.samples and self.batches > 1 and rows > 1:
            rng = np.random.default_rng([self.seed, self.batches])
            old, new = (sample_correlations(rng, self.sigma, n, self.samples) for n in (1 / self.spread, rows))
            seen = differences(self.sigma, own)[0]
            self.p_change = (1 + int((frobenius(old, new) >= seen).sum())) / (1 + self.samples)
            if self.p_change <= self.level:
                self.since, self.spread = 0, 1 / rows
                return own
        d = batch_decay(self.since, self.changing)
        # a weighted mean of batches has the variance of their rows, each by its weight's square
        self.spread = d * d / rows + (1 - d) * (1 - d) * self.spread if self.batches > 1 else 1 / rows
        return d * own + (1 - d) * self.sigma

    def step(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One batch, rows x features with NaN for what is missing; the batch with its missing cells filled, and its latents."""
        self._see(x)
        x = np.concatenate((x, np.full((len(x), len(self.rings) - x.shape[1]), np.nan)), axis=1)
        z, lo, hi = self._latent(x)
        latents, c = expect_rows(z, lo, hi, self.sigma)
        self.sigma = self._moved(_next_matrix(len(x), latents.sum(0), latents.T @ latents + c, self.sigma), len(x))
        out = x.copy()
        for k in range(x.shape[1]):
            gone = np.isnan(x[:, k])
            if gone.any():
                out[gone, k] = self._inverse(k, latents[gone, k])
            if not len(self.rings[k]):
                latents[:, k] = np.nan
        return out, latents


#: What imputation along a stream returns for each row, beside its key.
IMPUTED = "row_id long, values array<double>, latents array<double>, p_change double"


def filled_batch(state: StreamState, row_ids, xs) -> pd.DataFrame:
    """The next batch of a stream, as rows of :data:`IMPUTED`; a row may be shorter than others."""
    rows = np.full((len(xs), max(1, *map(len, xs))), np.nan)
    for i, r in enumerate(xs):
        rows[i, : len(r)] = [np.nan if v is None else v for v in r]
    cells = [[[None if v != v else v for v in r] for r in a.tolist()] for a in state.step(rows)]
    return pd.DataFrame({"row_id": list(row_ids), "values": cells[0], "latents": cells[1], "p_change": [state.p_change] * len(xs)})


def impute_stream(df: DataFrame, key: str, order: str, features: str, ordinal: list[int], window: int, batch: int, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """(key, row_id, values, latents, p_change, *carry): each key's rows, in order and in batches of ``batch``, in both spaces.

    ``values`` are the row's with its missing cells filled, ``latents`` the same cells in the latent
    space, as :class:`StreamState` gives them; ``p_change`` is that of the row's batch. ``features``:
    an array column; later rows may be longer. ``carry``: columns that go along, of other names than
    these. Streams of different keys run in parallel; a task holds one batch and one state, however
    long a stream is. Rows without a key or features are left
    out. An empty table gives an empty result.
    """
    x = F.col(features).cast("array<double>")
    # in ranges of a given number: a few long streams neither meet by their hashes nor are brought together as small partitions
    slim = df.select(F.col(key).alias("key"), F.col(order).cast("long").alias("row_id"), x.alias("_x"), *(F.col(c) for c in carry)).repartitionByRange(STREAM_TASKS, "key").sortWithinPartitions("key", "row_id")
    schema = StructType([slim.schema["key"], *StructType.fromDDL(IMPUTED), *(slim.schema[c] for c in carry)])

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        state: StreamState | None = None

        def filled(some: pd.DataFrame) -> pd.DataFrame:
            done = filled_batch(state, some["row_id"], some["_x"])
            done.insert(0, "key", some["key"].to_numpy())
            return pd.concat((done, some[list(carry)].reset_index(drop=True)), axis=1)

        at = None
        for pdf in pdfs:
            for _, part in pdf.groupby((pdf["key"] != pdf["key"].shift()).cumsum(), sort=False):
                now = part["key"].iloc[0]
                if state is None or now != at:
                    if held is not None and len(held):
                        yield filled(held)
                    state, held, at = StreamState(ordinal, window, **options), None, now
                held = part if held is None else pd.concat((held, part))
                while len(held) >= batch:
                    yield filled(held.iloc[:batch])
                    held = held.iloc[batch:]
        if held is not None and len(held):
            yield filled(held)

    return slim.where("key is not null and _x is not null").mapInPandas(work, schema)


def differences(old: np.ndarray, new: np.ndarray) -> tuple[float, float, float]:
    """Frobenius, spectral and nuclear norm of the new matrix seen from the old one, less identity."""
    w, v = np.linalg.eigh(old)
    half = v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ v.T
    s = np.linalg.svd(half @ new @ half - np.eye(len(old)), compute_uv=False)
    return float(np.sqrt((s * s).sum())), float(s.max()), float(s.sum())


def frobenius(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The first of :func:`differences` for many pairs of matrices at once."""
    w, v = np.linalg.eigh(old)
    half = v / np.sqrt(np.maximum(w, 1e-12))[:, None, :] @ v.transpose(0, 2, 1)
    apart = half @ new @ half - np.eye(old.shape[-1])
    return np.sqrt((apart * apart).sum((1, 2)))


def sample_correlations(rng: np.random.Generator, law: np.ndarray, rows: float, samples: int) -> np.ndarray:
    """Correlations of ``samples`` samples of ``rows`` normal rows: Bartlett's decomposition, whatever the number of rows."""
    p = len(law)
    a = np.tril(rng.standard_normal((samples, p, p)), -1)
    a[:, range(p), range(p)] = np.sqrt(rng.chisquare(np.maximum(rows - 1 - np.arange(p), 1), (samples, p)))
    w, v = np.linalg.eigh(law)
    half = v * np.sqrt(np.maximum(w, 1e-12)) @ v.T @ a
    c = half @ half.transpose(0, 2, 1)
    d = np.sqrt(c[:, range(p), range(p)])
    return c / (d[:, :, None] * d[:, None, :])


def _drawn(old: np.ndarray, rows: int, seed: int, i: int) -> tuple[float, float, float]:
    x = np.random.default_rng([seed, i]).multivariate_normal(np.zeros(len(old)), old, rows)
    return differences(old, to_correlation(np.cov(x.T)))


def change_test(spark, old: np.ndarray, new: np.ndarray, rows: int, samples: int = 100, seed: int = 1) -> tuple[float, ...]:
    """p-values of the three differences: how often fresh samples from the old law differ as much."""
    seen = differences(old, new)

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame([_drawn(old, rows, seed, int(i)) for i in pdf["id"]], columns=["a", "b", "c"])

    drawn = spark.range(samples).mapInPandas(work, "a double, b double, c double")
    r = drawn.agg(*(F.count_if(F.col(c) >= v) for c, v in zip("abc", seen, strict=True))).first()
    return tuple((k + 1) / (samples + 1) for k in r)


def batch_changes(rows: DataFrame, width: int, size: int, samples: int = 100, seed: int = 1) -> DataFrame:
    """(batch, frobenius, spectral, nuclear): :func:`change_test` of each batch of ``size`` rows against the one before.

    The earlier batch is fitted by EM. A task holds two batches at a time.
    """

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        j = key[0]
        before, now = (pdf[(pdf["row_id"] // size) == k].sort_values("row_id") for k in (j - 1, j))
        names = ["frobenius", "spectral", "nuclear"]
        if len(before) < 2 or len(now) < 2:
            return pd.DataFrame(columns=["batch", *names]).astype({"batch": "int64"} | dict.fromkeys(names, "float64"))
        old = _until_still(lambda sigma: _local_moments(before, sigma), width, 50, 0.01)
        seen = differences(old, _local_moments(now, old))
        drawn = np.array([_drawn(old, len(now), seed, i) for i in range(samples)])
        return pd.DataFrame([(j, *((1 + (drawn >= seen).sum(0)) / (samples + 1)))], columns=["batch", *names])

    j = F.floor(F.col("row_id") / size)
    both = rows.select("row_id", "z", "lo", "hi", F.explode(F.array(j, j + 1)).alias("batch"))
    return both.groupBy("batch").applyInPandas(work, "batch long, frobenius double, spectral double, nuclear double")
