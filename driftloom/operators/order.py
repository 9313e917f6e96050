"""Places, running sums and quantiles without a window over a whole column.

Rows are dealt in ranges of key and value by the cluster, numbered within their range, and moved by
the sizes of the ranges before: one row for each range and key. A column of any length is spread
over all tasks; what one task ranks is one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.lineage import cut


def _ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with _row, which ascends with key and order; its bits from 33 on are the range."""
    by = [key, *order]
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()))


def placed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(…, place, total): each row's place, from 0, among the rows of its key, and how many those are."""
    rows = _ranged(df, key, order).withColumn("_part", F.shiftright("_row", 33))
    parts = rows.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    w = Window.partitionBy(key)
    before = F.sum("_size").over(w.orderBy("_part")) - F.col("_size")
    parts = parts.select(key, "_part", "_first", before.alias("_before"), F.sum("_size").over(w).alias("total"))
    out = rows.join(parts, [key, "_part"])
    return out.withColumn("place", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")


def cumulative(counts: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """(…, upto, total): sum of ``n`` over the key's rows with no larger value, and over all of them. Values are distinct."""
    rows = _ranged(counts, key, [value]).withColumn("_part", F.shiftright("_row", 33))
    parts = rows.groupBy(key, "_part").agg(F.sum(n).alias("_size"))
    w = Window.partitionBy(key)
    before = F.sum("_size").over(w.orderBy("_part")) - F.col("_size")
    parts = parts.select(key, "_part", before.alias("_before"), F.sum("_size").over(w).alias("total"))
    inside = F.sum(n).over(Window.partitionBy(key, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_inside", inside).join(parts, [key, "_part"])
    return out.withColumn("upto", F.col("_inside") + F.col("_before")).drop("_part", "_row", "_inside", "_before")


def running(counts: DataFrame, keys: list[str], value: str, ns: list[str]) -> DataFrame:
    """(…, upto_n and total_n for each of ``ns``, next): sums over the key's rows with no larger value, over all of them, and the next larger value.

    Values are distinct within their key; the largest has no next.
    """
    rows = _ranged(counts.withColumn("_key", F.struct(*keys)), "_key", [value]).withColumn("_part", F.shiftright("_row", 33))
    parts = rows.groupBy("_key", "_part").agg(*(F.sum(n).alias(f"_{n}") for n in ns), F.min(value).alias("_first"))
    w = Window.partitionBy("_key")
    up = w.orderBy("_part")
    moved = [e for n in ns for e in ((F.sum(f"_{n}").over(up) - F.col(f"_{n}")).alias(f"_before_{n}"), F.sum(f"_{n}").over(w).alias(f"total_{n}"))]
    parts = parts.select("_key", "_part", *moved, F.lead("_first").over(up).alias("_after"))
    at = Window.partitionBy("_key", "_part").orderBy("_row")
    inside = {f"_in_{n}": F.sum(n).over(at.rowsBetween(Window.unboundedPreceding, 0)) for n in ns}
    out = rows.withColumns(inside | {"_next": F.lead(value).over(at)}).join(parts, ["_key", "_part"])
    done = {f"upto_{n}": F.col(f"_in_{n}") + F.col(f"_before_{n}") for n in ns} | {"next": F.coalesce("_next", "_after")}
    return out.withColumns(done).select(*counts.columns, *(c for n in ns for c in (f"upto_{n}", f"total_{n}")), "next")


def quantiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, q): an array of the exact quantiles at ``shares``, linear between neighbours; nulls do not count."""
    seen = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    sums = cumulative(seen, key, "_v", "_n")
    # values at whole places that a share needs: at most two a share
    at = [F.lit(float(s)) * (F.col("total") - 1) for s in shares]
    wanted = F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil)))
    holds = F.filter(wanted, lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("_n")))
    found = sums.select(key, "_v", "total", F.explode(F.array_distinct(holds)).alias("_p"))
    by = found.groupBy(key).agg(F.first("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("_p", "_v"))).alias("_m"))
    low, high = ([F.col("_m")[f(x).cast("long")] for x in at] for f in (F.floor, F.ceil))
    mixed = [a + (b - a) * (x - F.floor(x)) for a, b, x in zip(low, high, at, strict=True)]
    return by.select(key, F.array(*mixed).alias("q"))


def value_at(df: DataFrame, value: str, place: int, buckets: int = 1024, few: int = 4096) -> float | None:
    """The value at a place, from 0, of a column of numbers: counts by ranges narrow it down, so the driver sees counts and at most ``few`` values."""
    col = F.col(value).cast("double")
    rows = df.where(col.isNotNull()).select(col.alias("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not 0 <= place < n:
        return None
    while n > few and low < high:
        inside = rows.where(F.col("v").between(low, high))
        bucket = F.least(F.floor((F.col("v") - low) / (high - low) * buckets), F.lit(buckets - 1))
        for r in inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect():
            if place < r.n:
                break
            place -= r.n
        n, low, high = r.n, r.low, r.high
    if low == high:
        return low
    return sorted(r.v for r in rows.where(F.col("v").between(low, high)).collect())[place]
