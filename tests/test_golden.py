"""Published result traces, where TRACE_DIR names folders of them: running error, running square error, decay.

Each folder holds one stream's label, predict, error, mse and decay files (one number per line), and
its name ends in the decay schedule and the share of blending, as in ``x-4-0.02``.
"""

import os
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import online
from driftloom.sources import readers

CASES = sorted(glob(os.environ.get("TRACE_DIR", "/nowhere") + "/*-*-*"))


def trace(spark, path):
    return [r.value for r in readers.read_vector(spark, path).coalesce(1).collect()]


@pytest.mark.parametrize("at", CASES)
def test_traces(spark, at):
    schedule, blend = int(at.split("-")[-2]), float(at.split("-")[-1])
    labels = np.array(trace(spark, f"{at}/label"))
    order = np.arange(len(labels))
    np.random.seed(1)
    np.random.shuffle(order)
    p = trace(spark, f"{at}/predict")
    rows = [(0, i, float(y), float(q)) for i, (y, q) in enumerate(zip(labels[order], p, strict=True))]
    df = spark.createDataFrame(rows, "key int, row_id long, y double, p double")
    w = online.running("key", "row_id")
    got = df.select("row_id", online.cer(F.col("y"), F.col("p"), w).alias("c"), online.cumulative_mse(F.col("y"), F.col("p"), w).alias("m")).orderBy("row_id").collect()
    assert np.allclose([r.c for r in got], trace(spark, f"{at}/error"), atol=1e-12)
    assert np.allclose([r.m for r in got], trace(spark, f"{at}/mse"), atol=1e-12)
    t = np.arange(1, len(rows) + 1)
    want = t / (t + 1) if schedule == 3 else 1 - np.log(t) / (2 * t)
    share = np.array([r.c for r in got])
    want = np.where(t > 30, want * (1 - blend) + blend * share, want) if blend else want
    assert np.allclose(want, trace(spark, f"{at}/decay"), atol=1e-12)
