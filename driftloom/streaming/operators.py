"""Structured Streaming forms of the stateful operators.

State is kept per key by the state store, so a stream of any length runs in bounded memory per
key and resumes from its checkpoint. Within a micro-batch rows are sorted by their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from driftloom.operators import copula
from driftloom.operators.online import STATE, ftrl_rows, start

_FIELDS = tuple(start())


def online_learner(stream: DataFrame, key: str, order: str, features: list[str], label: str, **options) -> DataFrame:
    """(key, row_id, y, p, loss, decay): the online learner over an unbounded stream for each key."""
    cells = F.array(*(F.col(f).cast("double") for f in features))
    slim = stream.select(F.col(key).alias("key"), F.col(order).cast("long").alias("row_id"), cells.alias("x"), F.col(label).cast("double").alias("y"))

    plain = lambda v: [float(a) for a in v] if isinstance(v, list) else int(v) if isinstance(v, int) else float(v)

    def run(k: Any, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values("row_id", kind="stable")
        old = dict(zip(_FIELDS, state.get, strict=True)) if state.exists else None
        if old:
            old |= {f: list(old[f]) for f in ("v", "h", "z")}
        out, new = ftrl_rows(list(zip(pdf["row_id"], pdf["x"], pdf["y"], strict=True)), state=old, **options)
        state.update(tuple(plain(new[f]) for f in _FIELDS))
        yield pd.DataFrame({"key": k[0], "row_id": pdf["row_id"], "y": pdf["y"], "p": [r[2] for r in out], "loss": [r[3] for r in out], "decay": [r[4] for r in out]})

    kind = slim.schema["key"].dataType.simpleString()
    schema = f"key {kind}, row_id long, y double, p double, loss double, decay double"
    return slim.groupBy("key").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def ring_window(stream: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """(key, values): after each micro-batch, each key's last ``size`` observed values, oldest first."""
    slim = stream.select(F.col(key).alias("key"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))

    def run(k: Any, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(pdfs)).dropna(subset=["v"]).sort_values("o", kind="stable")["v"].tolist()
        kept = ((list(state.get[0]) if state.exists else []) + new)[-size:]
        state.update(([float(v) for v in kept],))
        yield pd.DataFrame({"key": [k[0]], "values": [kept]})

    kind = slim.schema["key"].dataType.simpleString()
    return slim.groupBy("key").applyInPandasWithState(run, f"key {kind}, values array<double>", "kept array<double>", "update", GroupStateTimeout.NoTimeout)


def copula_batches(stream: DataFrame, width: int, ordinal: list[int], path: str, checkpoint: str, changing: bool = True):
    """Online EM by micro-batch: each batch of (row_id, feature_id, value) moves the matrix and is written imputed under ``path``.

    Batch j goes to ``path``/rows/batch=j and the matrix after it to ``path``/matrix/batch=j, each
    written over: a batch that is tried again, or a query that is started again, goes on from the
    matrix of the batch before. Returns the query, started with all data available now.
    """
    def matrix_at(spark, j: int):
        if j < 0:
            return np.eye(width)
        rows = spark.read.schema("i int, row array<double>").parquet(f"{path}/matrix/batch={j}").orderBy("i").collect()
        return np.array([r.row for r in rows])

    def step(batch: DataFrame, j: int) -> None:
        spark = batch.sparkSession
        before = matrix_at(spark, j - 1)
        rows = copula.rows_of(copula.latent(batch, ordinal), width)
        d = copula.batch_decay(j + 1, changing)
        sigma = d * copula.moments(rows, before) + (1 - d) * before
        copula.impute(batch, ordinal, width, sigma).write.mode("overwrite").parquet(f"{path}/rows/batch={j}")
        done = spark.createDataFrame([(i, row) for i, row in enumerate(sigma.tolist())], "i int, row array<double>")
        done.coalesce(1).write.mode("overwrite").parquet(f"{path}/matrix/batch={j}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Imputer(StatefulProcessor):
    """One stream's :class:`~driftloom.operators.copula.StreamState` in the state store.

    The window of each feature is an entry of a map, so that a feature may appear at any time; the
    matrix and the counts of batches are one value; rows wait in a list until a batch is full.
    """

    def __init__(self, ordinal: list[int], window: int, batch: int, options: dict):
        self.made, self.batch = (lambda: copula.StreamState(ordinal, window, **options)), batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "row_id long, x array<double>")
        self.rings = handle.getMapState("rings", "feature int", "seen array<double>")
        self.known = handle.getValueState("known", "sigma array<double>, batches long, since long, spread double")

    def _state(self) -> copula.StreamState:
        state = self.made()
        if self.known.exists():
            sigma, state.batches, state.since, state.spread = self.known.get()
            width = int(np.sqrt(len(sigma)))
            state.sigma = np.array(sigma, float).reshape(width, width)
            found = {int(k[0]): np.array(v[0], float) for k, v in self.rings.iterator()}
            state.rings = [found.get(k, np.zeros(0)) for k in range(width)]
        return state

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("row_id", kind="stable")
        wait = [(int(i), list(x)) for i, x in self.held.get()] if self.held.exists() else []
        wait += [(int(i), [None if v is None or v != v else float(v) for v in x]) for i, x in zip(new["row_id"], new["x"], strict=True)]
        if len(wait) >= self.batch:
            state = self._state()
            while len(wait) >= self.batch:
                ids, xs = zip(*wait[: self.batch], strict=True)
                done = copula.filled_batch(state, ids, xs)
                done.insert(0, "key", [key[0]] * len(done))
                yield done
                wait = wait[self.batch :]
            for k, ring in enumerate(state.rings):
                self.rings.updateValue((k,), (ring.tolist(),))
            self.known.update((state.sigma.ravel().tolist(), state.batches, state.since, float(state.spread)))
        if wait:
            self.held.put(wait)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def impute_stream(stream: DataFrame, key: str, order: str, features: str, ordinal: list[int], window: int, batch: int, **options) -> DataFrame:
    """(key, row_id, values, latents, p_change): :func:`driftloom.operators.copula.impute_stream` over an unbounded stream.

    Rows of a key come in order; however they are cut into micro-batches, they give what the whole
    stream would. Rows wait in the state store until ``batch`` of their key are there. Needs the
    RocksDB state store. Rows without a key or features are left out.
    """
    x = F.col(features).cast("array<double>")
    slim = stream.select(F.col(key).alias("key"), F.col(order).cast("long").alias("row_id"), x.alias("x")).where("key is not null and x is not null")
    schema = StructType([slim.schema["key"], *StructType.fromDDL(copula.IMPUTED)])
    return slim.groupBy("key").transformWithStateInPandas(_Imputer(ordinal, window, batch, options), schema, "Append", "None")


def _gone(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tree_batches(stream: DataFrame, make, path: str, checkpoint: str):
    """A tree along a stream (``make()``: a new StreamTree or TwoSpaces): each micro-batch is predicted, then learned from.

    The tree and its tables are versioned by batch: batch j reads version j - 1 and writes version
    j to ``path``/tree/batch=j and its rows, with what the tree said, to ``path``/rows/batch=j, each
    written over. A batch that is tried again, or a query that is started again, thus goes on from
    the tree of the batch before. The last two versions are kept. Which leaf a row waits at depends
    on splits of the batch before, so state is dealt by leaf anew for every batch, and a batch's
    leaves are worked on in parallel. Returns the query, started with all data available now.
    """

    def step(batch: DataFrame, j: int) -> None:
        spark = batch.sparkSession
        tree = make()
        if j:
            tree.load(spark, f"{path}/tree/batch={j - 1}")
        tree.step(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={j}")
        tree.save(f"{path}/tree/batch={j}")
        if j > 1:
            _gone(spark, f"{path}/tree/batch={j - 2}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
