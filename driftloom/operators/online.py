"""The adaptive online logistic learner and what is measured along a stream.

A stream is the rows of one key in order. Streams are brought together by one shuffle and sorted
within their partitions, so that Arrow batches pass by in order and only the state of the key at
hand is held, however long its stream. A row is predicted before it is learned from; a row without
a label to learn from is predicted only. Rows may be shorter than those before: only the features
they have are seen and updated. For endless streams there is
:func:`driftloom.streaming.online_learner`, which keeps the state between micro-batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = "v array<double>, h array<double>, z array<double>, r double, t long, fails long, tw long, fw long, pm double, sm double"

STATE_SCHEMA = f"state struct<{STATE.replace(' ', ':').replace(',:', ',')}>"


def start() -> dict:
    """The state before the first row. tw, fw: rows and errors since a warning; pm, sm: the lowest error rate and its deviation."""
    return {"v": [], "h": [], "z": [], "r": 1.0, "t": 0, "fails": 0, "tw": 0, "fw": 0, "pm": 1.0, "sm": 10.0}


def _decay(schedule: int, t: float) -> float:
    return ((math.cbrt(t) - 1) / math.cbrt(t), (math.sqrt(t) - 1) / math.sqrt(t), (t - 1) / t, t / (t + 1), 1 - math.log(t) / (2 * t))[schedule]


def _drifted(s: dict, err: int, decay: float, blend: float) -> float:
    """The decay blended with the error rate; warnings are counted, and a drift starts the counts anew."""
    t = s["t"]
    rate = s["fails"] / t
    spread = math.sqrt(max(rate * (1 - rate), 0.0) / t)
    if rate + spread < s["pm"] + s["sm"]:
        s["pm"], s["sm"] = rate, spread
    if rate + spread < s["pm"] + 2 * s["sm"]:
        s["tw"] = s["fw"] = 0
    else:
        s["tw"] += 1
        s["fw"] += err
        if rate + spread > s["pm"] + 3 * s["sm"]:
            s |= {"t": s["tw"], "fails": s["fw"], "tw": 0, "fw": 0, "pm": 1.0, "sm": 10.0}
    return decay * (1 - blend) + blend * rate


def ftrl_rows(rows: Iterable[tuple], schedule: int = 3, blend: float = 0.0, drift: bool = False, l1: float = 0.0, l2: float = 0.0, lp: float = 1.0, state: dict | None = None):
    """The learner over one key's (order, features, label) rows: outputs (order, score, p, loss, decay), and the state to go on from.

    The score is the inner product before the sigmoid. A null label predicts only: no loss, no decay.
    """
    s = state or start()
    out = []
    for o, x, y in rows:
        x = [0.0 if a is None or a != a else a for a in (() if x is None else x)]
        for name in ("v", "h", "z"):
            s[name].extend([0.0] * (len(x) - len(s[name])))
        w = [0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / (l2 + lp * s["r"]) for z in s["z"][: len(x)]]
        score = 0.0
        for a, b in zip(w, x, strict=True):
            score += a * b
        p = 1 / (1 + math.exp(-score)) if score >= 0 else math.exp(score) / (1 + math.exp(score))
        if y is None or y != y:
            out.append((o, score, p, None, None))
            continue
        loss = max(score, 0.0) - y * score + math.log(1 + math.exp(-abs(score)))
        err = int(abs(y - p) > 0.5)
        s["t"] += 1
        s["fails"] += err
        decay = _decay(schedule, float(s["t"]))
        if drift and s["t"] > 30:
            decay = _drifted(s, err, decay, blend)
        for i, (a, b) in enumerate(zip(w, x, strict=True)):
            s["v"][i] += (p - y) * b
            s["h"][i] = decay * s["h"][i] + a
            s["z"][i] = s["v"][i] - lp * s["h"][i]
        s["r"] = 1 + decay * s["r"]
        out.append((o, score, p, loss, decay))
    return out, s


#: Streams that are stepped together; fewer go row by row.
LANES = 16


def _decays(schedule: int, t: np.ndarray) -> np.ndarray:
    return ((np.cbrt(t) - 1) / np.cbrt(t), (np.sqrt(t) - 1) / np.sqrt(t), (t - 1) / t, t / (t + 1), 1 - np.log(t) / (2 * t))[schedule]


class _Lanes:
    """The states of many streams, longest first, whose rows at one place are learned together."""

    _COUNTS = ("t", "fails", "tw", "fw")

    def __init__(self, lanes: int, width: int):
        self.v, self.h, self.z = (np.zeros((lanes, width)) for _ in range(3))
        self.r, self.pm, self.sm = np.ones(lanes), np.ones(lanes), np.full(lanes, 10.0)
        self.t, self.fails, self.tw, self.fw = (np.zeros(lanes, np.int64) for _ in range(4))
        self.width = np.zeros(lanes, np.int64)

    def put(self, lane: int, state: dict) -> None:
        self.width[lane] = len(state["z"])
        for f, value in state.items():
            if f in ("v", "h", "z"):
                getattr(self, f)[lane, : len(value)] = value
            else:
                getattr(self, f)[lane] = value

    def get(self, lane: int) -> dict:
        wide = {f: getattr(self, f)[lane, : self.width[lane]].tolist() for f in ("v", "h", "z")}
        return wide | {f: (int if f in self._COUNTS else float)(getattr(self, f)[lane]) for f in ("r", "t", "fails", "tw", "fw", "pm", "sm")}

    def step(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, schedule: int = 3, blend: float = 0.0, drift: bool = False, l1: float = 0.0, l2: float = 0.0, lp: float = 1.0) -> tuple[np.ndarray, ...]:
        """One row of each of the first lanes: score, p, loss and decay, as :func:`ftrl_rows` gives them; NaN for null."""
        n = len(y)
        self.width[:n] = np.maximum(self.width[:n], sizes)
        has, known = np.arange(x.shape[1]) < sizes[:, None], ~np.isnan(y)
        v, h, z, r = self.v[:n], self.h[:n], self.z[:n], self.r[:n]
        w = np.where((np.abs(z) <= l1) | ~has, 0.0, -(z - np.copysign(l1, z)) / (l2 + lp * r)[:, None])
        score = np.zeros(n)
        for f in range(x.shape[1]):
            score += w[:, f] * x[:, f]
        e = np.exp(-np.abs(score))
        p = np.where(score >= 0, 1 / (1 + e), e / (1 + e))
        loss = np.maximum(score, 0.0) - y * score + np.log(1 + e)
        err = (known & (np.abs(y - p) > 0.5)).astype(np.int64)
        self.t[:n] += known
        self.fails[:n] += err
        decay = _decays(schedule, np.maximum(self.t[:n], 1).astype(float))
        if drift:
            decay = self._drifted(known & (self.t[:n] > 30), err, decay, blend)
        learns = has & known[:, None]
        v += np.where(learns, np.where(known, p - y, 0.0)[:, None] * x, 0.0)
        h[:] = np.where(learns, decay[:, None] * h + w, h)
        z[:] = np.where(learns, v - lp * h, z)
        r[:] = np.where(known, 1 + decay * r, r)
        return score, p, np.where(known, loss, np.nan), np.where(known, decay, np.nan)

    def _drifted(self, at: np.ndarray, err: np.ndarray, decay: np.ndarray, blend: float) -> np.ndarray:
        n = len(at)
        t, fails, tw, fw, pm, sm = (getattr(self, f)[:n] for f in ("t", "fails", "tw", "fw", "pm", "sm"))
        rate = fails / np.maximum(t, 1)
        spread = np.sqrt(np.maximum(rate * (1 - rate), 0.0) / np.maximum(t, 1))
        low = at & (rate + spread < pm + sm)
        pm[low], sm[low] = rate[low], spread[low]
        calm = at & (rate + spread < pm + 2 * sm)
        tw[calm] = fw[calm] = 0
        warned = at & ~calm
        tw[warned] += 1
        fw[warned] += err[warned]
        back = warned & (rate + spread > pm + 3 * sm)
        t[back], fails[back] = tw[back], fw[back]
        tw[back] = fw[back] = 0
        pm[back], sm[back] = 1.0, 10.0
        return np.where(at, decay * (1 - blend) + blend * rate, decay)


def _dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An array column as rows x features, 0 for null or NaN, and each row's number of features."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)))
    flat = pc.fill_null(column.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    x[np.arange(x.shape[1]) < sizes[:, None]] = np.nan_to_num(flat, nan=0.0, posinf=np.inf, neginf=-np.inf)
    return x, sizes


def ftrl_streams(runs: list[tuple[int, int]], xs: pa.Array, labels: pa.Array, first: dict | None, others: dict | None = None, **options) -> tuple[np.ndarray, list[dict]]:
    """The learner over several streams, each a run of rows: (score, p, loss, decay) by row, NaN for null, and the state after each.

    ``first`` is what is known of the first stream, ``others`` what is known of all others. Rows at
    the same place of their streams are learned together; where fewer than ``LANES`` streams go on
    so far, each goes row by row. Streams are independent, so both ways give the same.
    """
    x, sizes = _dense(xs)
    y = pc.fill_null(labels, math.nan).to_numpy(zero_copy_only=False).astype(float)
    out = np.full((4, len(y)), np.nan)
    befores = [first if i == 0 else others for i in range(len(runs))]
    width = max([x.shape[1], *(len(b["z"]) for b in (first, others) if b)])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    by_length = sorted(range(len(runs)), key=lambda i: runs[i][0] - runs[i][1])
    starts, lengths = (np.array([f(runs[i]) for i in by_length], np.int64) for f in (lambda r: r[0], lambda r: r[1] - r[0]))
    lanes = _Lanes(len(runs), width)
    for lane, i in enumerate(by_length):
        if befores[i]:
            lanes.put(lane, befores[i])
    done = 0
    while len(runs) >= LANES and (n := int((lengths > done).sum())) >= LANES:
        at = starts[:n] + done
        out[:, at] = lanes.step(x[at], sizes[at], y[at], **options)
        done += 1
    states: list[dict] = [{}] * len(runs)
    for lane, i in enumerate(by_length):
        state = lanes.get(lane)
        a, z = runs[i][0] + done, runs[i][1]
        if a < z:
            rows = ((None, x[k, : sizes[k]].tolist(), y[k]) for k in range(a, z))
            found, state = ftrl_rows(rows, state=state, **options)
            out[:, a:z] = np.array([r[1:] for r in found], float).T
        states[i] = state
    return out, states


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    """Where equal neighbours start and end."""
    a = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[a]:
            yield a, i
            a = i


def _streams(df: DataFrame, key: str, order: str, features: list[str] | str, label: str, learn_from: str | None) -> DataFrame:
    """(key, row_id, x, y, label) with each key's rows together and in order."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(f).cast("double") for f in features))
    y = F.col(label).cast("double")
    slim = df.select(F.col(key).alias("key"), F.col(order).cast("long").alias("row_id"), x.alias("x"), y.alias("y"), (F.col(learn_from).cast("double") if learn_from else y).alias("label"))
    return slim.repartition("key").sortWithinPartitions("key", "row_id")


def replay(df: DataFrame, key: str, order: str, features: list[str] | str, label: str, learn_from: str | None = None, **options) -> DataFrame:
    """(key, row_id, y, score, p, loss, decay) for each row: the learner run along each key's stream.

    ``features``: columns, or one array column whose rows may differ in length. ``label`` is what
    results are measured against; the learner is told ``learn_from`` (by default the same), and
    only predicts where that is null. A null key is a stream of its own. An empty table gives an
    empty result.
    """
    slim = _streams(df, key, order, features, label, learn_from)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            runs = list(_runs(keys))
            if not runs:
                continue
            out, states = ftrl_streams(runs, batch.column(2), batch.column(4), state if keys[0] == at else None, **options)
            at, state = keys[-1], states[-1]
            done = [pa.array(c, pa.float64(), from_pandas=True) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *done], names=["key", "row_id", "y", "score", "p", "loss", "decay"])

    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(work, f"key {kind}, row_id long, y double, score double, p double, loss double, decay double")


def learned(df: DataFrame, key: str, order: str, features: list[str] | str, label: str, start_from: dict | None = None, **options) -> DataFrame:
    """(key, state): what the learner knows at the end of each key's stream; see :func:`predict`. ``start_from``: what it knows before."""
    slim = _streams(df, key, order, features, label, None)
    kind = slim.schema["key"].dataType.simpleString()
    schema = slim.sparkSession.createDataFrame([], f"key {kind}, {STATE_SCHEMA}").schema
    fields = list(start())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        held, state = None, None

        def given(keys: pa.Array, states: list[dict]) -> pa.RecordBatch:
            kinds = to_arrow_schema(schema)
            return pa.RecordBatch.from_arrays([keys, pa.array([{f: one[f] for f in fields} for one in states], kinds.field("state").type)], names=["key", "state"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            runs = list(_runs(keys))
            if not runs:
                continue
            goes_on = held is not None and held[0].as_py() == keys[0]
            if held is not None and not goes_on:
                yield given(held, [state])
            _, states = ftrl_streams(runs, batch.column(2), batch.column(4), state if goes_on else start_from, start_from, **options)
            if len(runs) > 1:
                yield given(batch.column(0).take(pa.array([a for a, _ in runs[:-1]])), states[:-1])
            held, state = batch.column(0).slice(runs[-1][0], 1), states[-1]
        if held is not None:
            yield given(held, [state])

    return slim.mapInArrow(work, schema)


def weights(state: Column, l1: float = 0.0, l2: float = 0.0, lp: float = 1.0) -> Column:
    """The learner's weights from its state; those whose signal is within ``l1`` are zero."""
    return F.transform(state["z"], lambda z: F.when(F.abs(z) <= l1, 0.0).otherwise(-(z - l1 * F.signum(z)) / (l2 + lp * state["r"])))


def predict(state: Column, x: Column, **options) -> Column:
    """The probability that a learned state gives to features; missing ones count as zero. In the JVM."""
    products = F.zip_with(weights(state, **options), x, lambda a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0)))
    return _sigmoid(F.aggregate(products, F.lit(0.0), lambda a, b: a + b))


def _sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def running(key: str, order: str):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def cer(y: Column, p: Column, w) -> Column:
    """Cumulative error rate: the running share of predictions more than one half off."""
    return F.avg((F.abs(y - p) > 0.5).cast("double")).over(w)


def cumulative_mse(y: Column, p: Column, w) -> Column:
    return F.avg((p - y) * (p - y)).over(w)


def ensemble(x: DataFrame, z: DataFrame, eta: float = 0.001) -> DataFrame:
    """(key, row_id, y, lam, p): two replays of one stream, weighted by their losses so far.

    The weight used for a row knows the losses of the rows before it only; rows that were only
    predicted have no loss and leave it as it is. Both start with half of the weight.
    """
    both = x.select("key", "row_id", "y", F.col("score").alias("sx"), F.col("loss").alias("lx")).join(
        z.select(F.col("key").alias("key_z"), F.col("row_id").alias("row_z"), F.col("score").alias("sz"), F.col("loss").alias("lz")),
        F.col("key").eqNullSafe(F.col("key_z")) & (F.col("row_id") == F.col("row_z")),
    )
    w = Window.partitionBy("key").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.sum(F.col("lx") - F.col("lz")).over(w), F.lit(0.0))
    both = both.withColumn("lam", 1 / (1 + F.exp(eta * gap)))
    p = _sigmoid(F.col("lam") * F.col("sx") + (1 - F.col("lam")) * F.col("sz"))
    return both.select("key", "row_id", "y", "lam", p.alias("p"))
