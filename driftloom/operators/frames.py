"""Shaping a stream: masks, trapezoids, batches, interleaving, column typing, discretisation.

Choices that are random in spirit come from an integer mixing of row and column, so that a result
does not depend on partitions and can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators import order

CONTINUOUS_FROM = 15


def draw(row: Column, column: Column | int = 0, seed: int = 0) -> Column:
    """A whole number below 2 ** 31 for a row and column."""
    one = (row * 1103515245 + F.lit(column) * 12345 + seed) % 2147483648
    return (one * 48271 + 11) % 2147483647


def to_long(df: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """(row_id, feature_id, value): one scan, no shuffle."""
    cells = F.array(*(F.col(f).cast("double") for f in features))
    return df.select(F.col(row_id).alias("row_id"), F.posexplode(cells).alias("feature_id", "value"))


def to_array(long: DataFrame) -> DataFrame:
    """(row_id, features) with cells in the order of their features."""
    cells = F.array_sort(F.collect_list(F.struct("feature_id", "value")))
    return long.groupBy("row_id").agg(F.transform(cells, lambda c: c["value"]).alias("features"))


def mask_pairs(features: Column, row: Column, seed: int = 0) -> Column:
    """Of each pair of neighbouring columns one cell becomes null; an odd last column stays."""
    n = F.size(features)
    gone = lambda i: (draw(row, F.floor(i / 2), seed) % 2 == i % 2) & (i < n - n % 2)
    return F.transform(features, lambda x, i: F.when(~gone(i), x))


def mask_fraction(long: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Nulls ``fraction`` of the observed cells, never a row's last one: its lowest draw is kept.

    A cell goes if its draw is below the fraction, so there is no global rank and no retry.
    """
    u = draw(F.col("row_id"), F.col("feature_id"), seed)
    observed = F.col("value").isNotNull()
    low = F.min(F.when(observed, F.struct(-u, "feature_id"))).over(Window.partitionBy("row_id"))
    gone = observed & (u < int(fraction * 2147483647)) & (F.col("feature_id") != low["feature_id"])
    return long.withColumn("value", F.when(~gone, F.col("value")))


def mask_per_row(long: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Nulls ``size`` cells of each row, drawn without replacement."""
    w = Window.partitionBy("row_id").orderBy(draw(F.col("row_id"), F.col("feature_id"), seed), "feature_id")
    ranked = long.withColumn("_r", F.row_number().over(w))
    return ranked.withColumn("value", F.when(F.col("_r") > size, F.col("value"))).drop("_r")


def labelled(row: Column, fraction: float = 0.5, seed: int = 0) -> Column:
    """Whether a row keeps its label; row 0 always does."""
    return (row == 0) | (draw(row, 0, seed) >= int(fraction * 2147483647))


def trapezoid(features: Column, position: Column, n: Column, blocks: int = 5) -> Column:
    """The prefix of features that a row shows: later blocks of rows show more columns."""
    block = F.floor(position / F.ceil(n / blocks)) + 1
    return F.slice(features, F.lit(1), F.least(F.size(features), (block * F.ceil(F.size(features) / blocks)).cast("int")))


def pad(features: Column, width: int, filler: float | None = None) -> Column:
    return F.concat(features, F.array_repeat(F.lit(filler).cast("double"), width - F.size(features)))


def fill_zero(features: Column) -> Column:
    return F.transform(features, lambda x: F.coalesce(x, F.lit(0.0)))


def with_bias(features: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), features)


def interleaved(label: Column, rank: Column, majors: Column, minors: Column, every: int, major: int = 0) -> Column:
    """0-based place after a minor row follows each ``every``-th major one, while there are any; ``rank`` is 0-based within the label."""
    on_major = rank + F.least(F.ceil(rank / every), minors)
    on_minor = F.when(rank < F.ceil(majors / every), rank * (every + 1) + 1).otherwise(majors + rank)
    return F.when(label == major, on_major).otherwise(on_minor).cast("long")


def batches(df: DataFrame, position: str, n: int, size: int, passes: int = 2) -> DataFrame:
    """(…, batch_id): circular batches over ``passes`` passes of a stream of n rows; a batch may wrap."""
    epoch = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("epoch")
    return df.select("*", epoch).withColumn("batch_id", F.floor((F.col("epoch") * n + F.col(position)) / size))


def continuous_features(long: DataFrame, least: int = CONTINUOUS_FROM) -> DataFrame:
    """(feature_id, is_cont): continuous from ``least`` distinct values on."""
    return long.groupBy("feature_id").agg((F.count_distinct("value") >= least).alias("is_cont"))


def drawn_cut(long: DataFrame, seed: int = 0) -> DataFrame:
    """(feature_id, cut): one of each feature's values between its tenth and ninetieth percentile, the one of smallest draw."""
    ends = order.quantiles(long, "feature_id", "value", [0.1, 0.9])
    inside = long.join(F.broadcast(ends), "feature_id").where(F.col("value").between(F.col("q")[0], F.col("q")[1]))
    first = inside.groupBy("feature_id").agg(F.min(F.struct(draw(F.col("row_id"), F.col("feature_id"), seed).alias("u"), "row_id", "value")).alias("f"))
    return first.select("feature_id", F.col("f.value").alias("cut"))


def binary(long: DataFrame, cuts: DataFrame) -> DataFrame:
    """(…, bit): whether a value exceeds its feature's cut."""
    return long.join(F.broadcast(cuts), "feature_id").withColumn("bit", (F.col("value") > F.col("cut")).cast("int")).drop("cut")


def interval_members(discretised: DataFrame) -> DataFrame:
    """(feature_id, bin, value, row_id, place): the members of each interval, by value; a row for each, so that an interval may be of any size."""
    return order.placed(discretised.where("bin is not null").withColumn("_k", F.struct("feature_id", "bin")), "_k", ["value", "row_id"]).select("feature_id", "bin", "value", "row_id", "place")


def equal_width(long: DataFrame, k: int) -> DataFrame:
    """(…, ordinal): how many of the k upper cuts a value exceeds."""
    ends = long.groupBy("feature_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cuts = sum((F.col("value") > F.col("lo") + (F.col("hi") - F.col("lo")) * i / k).cast("int") for i in range(1, k + 1))
    return long.join(ends, "feature_id").withColumn("ordinal", cuts).drop("lo", "hi")


def quantile_cuts(long: DataFrame, shares: list[float]) -> DataFrame:
    """(…, ordinal): how many of the exact quantiles at ``shares`` a value reaches."""
    cuts = order.quantiles(long, "feature_id", "value", shares).withColumnRenamed("q", "cuts")
    return long.join(F.broadcast(cuts), "feature_id").withColumn("ordinal", F.aggregate("cuts", F.lit(0), lambda a, c: a + (F.col("value") >= c).cast("int"))).drop("cuts")


def equal_frequency(long: DataFrame, chunks: int = 10) -> DataFrame:
    """(feature_id, bin, lo, hi): sorted values in chunks of floor(n / chunks); few distinct values are left out."""
    ranked = order.placed(long.where("value is not null").select("feature_id", "value", "row_id"), "feature_id", ["value", "row_id"])
    ranked = ranked.withColumn("bin", F.floor(F.col("place") / F.greatest(F.floor(F.col("total") / chunks), F.lit(1))))
    many = long.groupBy("feature_id").agg(F.count_distinct("value").alias("d")).where(F.col("d") > chunks)
    return ranked.join(many, "feature_id", "left_semi").groupBy("feature_id", "bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def discretised(long: DataFrame, bins: DataFrame) -> DataFrame:
    """(row_id, feature_id, value, bin): the last chunk that holds the value; features without chunks keep null."""
    b = bins.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi"))).alias("bins"))
    holds = F.filter("bins", lambda x: (x["lo"] <= F.col("value")) & (F.col("value") <= x["hi"]))
    return long.join(b, "feature_id", "left").select("row_id", "feature_id", "value", F.try_element_at(holds, F.lit(-1))["bin"].alias("bin"))
