"""Feature streams made of the test tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import frames

FEATURES = ["f0", "f1", "f2", "f3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, user_id, f0..f3, label): two continuous and two ordinal columns of the event stream."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "user_id", F.col("value").alias("f0"), k.cast("double").alias("f1"),
        (F.col("user_id") % 10).cast("double").alias("f2"), (k % 5).cast("double").alias("f3"), F.col("event_type").isin("purchase", "signup").cast("int").alias("label"),
    )


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.to_long(matrix(spark, sf_dir), "row_id", FEATURES)


def masked_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell of each pair of columns is missing."""
    u = frames.draw(F.col("row_id"), F.floor(F.col("feature_id") / 2))
    return long(spark, sf_dir).withColumn("value", F.when(u % 2 != F.col("feature_id") % 2, F.col("value")))


DRAW = "(((({row} * 1103515245 + {col} * 12345 + {seed}) % 2147483648) * 48271 + 11) % 2147483647)"


def draw(row: str, col: str = "0", seed: int = 0) -> str:
    return DRAW.format(row=f"({row})", col=f"({col})", seed=seed)


MATRIX = """m AS (SELECT event_id AS row_id, user_id, value AS f0, k::DOUBLE AS f1, (user_id % 10)::DOUBLE AS f2, (k % 5)::DOUBLE AS f3, label
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label FROM events))"""
LONG = MATRIX + """,
l AS (SELECT row_id, 0 AS feature_id, f0 AS value FROM m UNION ALL SELECT row_id, 1, f1 FROM m UNION ALL SELECT row_id, 2, f2 FROM m UNION ALL SELECT row_id, 3, f3 FROM m)"""
MASKED = LONG + f""",
k AS (SELECT row_id, feature_id, CASE WHEN {draw('row_id', 'feature_id // 2')} % 2 <> feature_id % 2 THEN value END AS value FROM l)"""
