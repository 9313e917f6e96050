"""Readers and writers of matrices, label vectors, ragged streams and result series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str, columns: int, sep: str = " ", absolute: bool = False, header: bool = False) -> DataFrame:
    """(features) from numeric text; NaN and empty cells become null. ``absolute``: magnitudes only; ``header``: the first line of a file names the columns."""
    schema = ", ".join(f"f{i} double" for i in range(columns))
    raw = spark.read.csv(path, sep=sep, schema=schema, nanValue="nan", header=header, enforceSchema=True)
    cells = [F.when(F.isnan(f"f{i}"), None).otherwise(F.abs(f"f{i}") if absolute else F.col(f"f{i}")) for i in range(columns)]
    return raw.select(F.array(*cells).alias("features"))


def read_vector(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(value) from one number per line."""
    return spark.read.text(path).select(F.trim("value").cast("double").cast(kind).alias("value"))


def parse_ragged(line: Column) -> Column:
    """A row written as "[a, b, ...]": an array in which NaN and null are 0."""
    values = F.from_json(F.regexp_replace(line, "(?i)nan", "null"), "array<double>")
    return F.transform(values, lambda x: F.coalesce(x, F.lit(0.0)))


def write_series(df: DataFrame, path: str, column: str, order: str) -> None:
    """One number per line, sorted across files by ``order``."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def ragged_text(values: Column) -> Column:
    """An array as "[a, b, ...]", null as nan; :func:`parse_ragged` reads it."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit("nan"))), ", "), F.lit("]"))


def write_ragged(df: DataFrame, path: str, column: str, order: str) -> None:
    """One row per line, sorted across files by ``order``."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(ragged_text(F.col(column))).write.mode("overwrite").text(path)


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """(features) as :func:`write_ragged` wrote them; what was null is 0."""
    return spark.read.text(path).select(parse_ragged(F.col("value")).alias("features"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header in each file; nulls are empty cells."""
    df.write.mode("overwrite").csv(path, header=True)


# Hyper-parameters of the two documented data sets by stream kind.
_SETTINGS = [
    ("cap", "australian", 0.01, 2, 10, 4, False),
    ("cap", "wdbc", 0.02, 2, 8, 0, True),
    ("tra", "australian", 0.02, 2, 10, 4, False),
    ("tra", "wdbc", 0.0, 2, 2, 3, True),
]


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SETTINGS, "kind string, dataset string, contribute_error_rate double, window_den int, batch_den int, decay_choice int, shuffle boolean")
