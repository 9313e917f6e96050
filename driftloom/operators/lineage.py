"""Cutting lineage in iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder; in a temporary one where none is configured (local tests)."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, order: str) -> DataFrame:
    """Like :func:`cut`, as Parquet in ranges of ``order``: a filter on it reads only the ranges that it needs."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.repartitionByRange(order).sortWithinPartitions(order).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which holds checkpoints."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:  # a local test has one machine; a cluster shares its warehouse
            local = re.fullmatch(r"local(\[.*\])?", context.master)
            at = tempfile.mkdtemp(prefix="spark-checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        context.setCheckpointDir(at)
    at = context.getCheckpointDir()
    if at not in _MARKED:
        # checkpoints and tables go when the driver ends; no result outlives its session
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _MARKED.add(at)
    return at
