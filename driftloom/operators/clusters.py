"""k-modes, its seeded variant with label repair, and distances between sets of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions import numeric
from driftloom.operators.frames import draw
from driftloom.operators.lineage import cut


def assign_modes(rows: DataFrame, centres: list[tuple], features: str = "x") -> DataFrame:
    """(…, cluster, mismatches): the centre of least Hamming distance, the first among equals.

    The few centres are literals of the plan: no join.
    """
    dist = [F.struct(numeric.hamming(F.col(features), F.array(*map(F.lit, c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]
    best = F.least(*dist) if len(dist) > 1 else dist[0]
    return rows.withColumn("_b", best).withColumn("cluster", F.col("_b.k")).withColumn("mismatches", F.col("_b.d")).drop("_b")


def modes(assigned: DataFrame, features: str = "x") -> DataFrame:
    """(cluster, feature, mode, n): the most frequent value of each, the smallest among equals."""
    cells = assigned.select("cluster", F.posexplode(features).alias("feature", "value"))
    counted = cells.groupBy("cluster", "feature", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy("cluster", "feature").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
    return best.select("cluster", "feature", F.col("b.value").alias("mode"), (-F.col("b.m")).alias("n"))


def k_modes(rows: DataFrame, centres: list[tuple], features: str = "x", most_rounds: int = 20) -> tuple[DataFrame, list[tuple]]:
    """Rounds of assignment and new modes until these stay; an empty cluster keeps its centre.

    The driver sees one row for each cluster and feature in a round.
    """
    for _ in range(most_rounds):
        assigned, new = assign_modes(rows, centres, features), [list(c) for c in centres]
        for r in modes(assigned, features).collect():
            new[r.cluster][r.feature] = r.mode
        if [tuple(c) for c in new] == centres:
            break
        centres = [tuple(c) for c in new]
    return assign_modes(rows, centres, features), centres


def seeds(rows: DataFrame, features: str = "x", order: str = "row_id", label: str = "label") -> list[tuple]:
    """The first labelled row of each class, by class."""
    first = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(F.struct(order, features)).alias("f")).orderBy(label)
    return [tuple(r["f"][1]) for r in first.collect()]


def seeds_drawn(rows: DataFrame, k: int, features: str = "x", order: str = "row_id", label: str = "label", seed: int = 0) -> list[tuple]:
    """A seed for each of ``k`` clusters: the first row of class 0, 1, …; a class without one takes an unlabelled row, by draw.

    Fewer, if the unlabelled rows do not suffice. The driver sees ``k`` rows.
    """
    named = rows.where(F.col(label).between(0, k - 1)).groupBy(label).agg(F.min(F.struct(order, features)).alias("f"))
    found = {r[0]: tuple(r["f"][1]) for r in named.collect()}
    empty = [i for i in range(k) if i not in found]
    drawn = rows.where(F.col(label).isNull()).orderBy(draw(F.col(order), seed=seed), order).limit(len(empty))
    found |= {i: tuple(r[0]) for i, r in zip(empty, drawn.select(features).collect(), strict=False)}
    return [found[i] for i in sorted(found)]


def repair_labels(assigned: DataFrame, label: str = "label") -> DataFrame:
    """(…, repaired): a missing label becomes its cluster's most frequent one, the smallest among equals."""
    counted = assigned.where(F.col(label).isNotNull()).groupBy("cluster", label).agg(F.count("*").alias("n"))
    major = counted.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("m"), label)).alias("b")).select("cluster", F.col(f"b.{label}").alias("_major"))
    return assigned.join(F.broadcast(major), "cluster", "left").withColumn("repaired", F.coalesce(label, "_major")).drop("_major")


def purity(assigned: DataFrame, label: str = "label") -> DataFrame:
    counted = assigned.groupBy("cluster", label).agg(F.count("*").alias("n"))
    return counted.groupBy("cluster").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("purity"))


def tightness(assigned: DataFrame, width: int) -> DataFrame:
    """(r): the mean over clusters of the mean share of attributes that equal the centre's."""
    return assigned.groupBy("cluster").agg(F.avg(1 - F.col("mismatches") / width).alias("s")).agg(F.avg("s").alias("r"))


def cluster_set_distances(old: DataFrame, new: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """(…keys, distance) of two sets of (…keys, cluster, feature, mode, n): 1 less the mean best similarity of the new to the old.

    Both sets hold a row per cluster and feature, so they are small whatever the data.
    """
    o = old.select(*keys, F.col("cluster").alias("oc"), "feature", F.col("mode").alias("om"), F.col("n").alias("on"))
    both = new.join(o, [*keys, "feature"]).groupBy(*keys, "cluster", "oc").agg(F.avg((F.col("mode") == F.col("om")).cast("double")).alias("s"), F.sum(F.col("n") + F.col("on")).alias("w"))
    best = both.groupBy(*keys, "cluster").agg(F.max(F.struct("s", "w")).alias("b"))
    mean = F.sum(F.col("b.s") * F.col("b.w")) / F.sum("b.w") if weighted else F.avg("b.s")
    return best.groupBy(*keys).agg((1 - mean).alias("distance"))


def cluster_set_distance(old: DataFrame, new: DataFrame, weighted: bool = False) -> DataFrame:
    """(distance): :func:`cluster_set_distances` of two whole sets."""
    return cluster_set_distances(old, new, [], weighted)


def mixed_distance(old: DataFrame, new: DataFrame, cells: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(distance) where numeric features are compared by their values: 1 less the mean best similarity of the new clusters to the old.

    ``old``, ``new``: (cluster, feature, mode, n) of the categorical features. ``cells``: old and new
    (cluster, feature, value) of the numeric ones; two clusters are as like in a feature as the
    share of both sides' values that lie between the other's ends.
    """
    same = new.join(old.select(F.col("cluster").alias("oc"), "feature", F.col("mode").alias("om")), "feature")
    same = same.select("cluster", "oc", "feature", (F.col("mode") == F.col("om")).cast("double").alias("s"))
    ends = [c.groupBy("cluster", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("k")) for c in cells]
    pair = ends[1].join(ends[0].select(F.col("cluster").alias("oc"), "feature", F.col("lo").alias("olo"), F.col("hi").alias("ohi"), F.col("k").alias("ok")), "feature")
    # values counted once for each cluster of the other side, of which there are few
    few = cut(pair)
    of_new = cells[1].join(F.broadcast(few), ["cluster", "feature"]).groupBy("cluster", "oc", "feature").agg(F.count_if(F.col("value").between(F.col("olo"), F.col("ohi"))).alias("a"))
    of_old = cells[0].withColumnRenamed("cluster", "oc").join(F.broadcast(few), ["oc", "feature"]).groupBy("cluster", "oc", "feature").agg(F.count_if(F.col("value").between(F.col("lo"), F.col("hi"))).alias("b"))
    near = few.join(of_new, ["cluster", "oc", "feature"]).join(of_old, ["cluster", "oc", "feature"])
    near = near.select("cluster", "oc", "feature", ((F.col("a") + F.col("b")) / (F.col("k") + F.col("ok"))).alias("s"))
    alike = same.unionByName(near).groupBy("cluster", "oc").agg(F.avg("s").alias("s"))
    return alike.groupBy("cluster").agg(F.max("s").alias("s")).agg((1 - F.avg("s")).alias("distance"))


def labels_by_match(rows: DataFrame, known: DataFrame, features: str = "x", label: str = "label") -> DataFrame:
    """(…, matched): each row's label from the rows of ``known`` with the same features, the smallest where they differ; null if there are none."""
    table = known.where(F.col(label).isNotNull()).groupBy(F.col(features).alias("_x")).agg(F.min(label).alias("matched"))
    return rows.join(table, F.col(features).eqNullSafe(F.col("_x")), "left").drop("_x")


def interval_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(feature, similarity) of (feature, value) samples: shares of either that fall between the other's ends."""
    ends = lambda d, p: d.groupBy("feature").agg(F.min("value").alias(f"{p}lo"), F.max("value").alias(f"{p}hi"))
    inside = lambda d, e, p: d.join(F.broadcast(e), "feature").select("feature", F.col("value").between(F.col(f"{p}lo"), F.col(f"{p}hi")).cast("int").alias("in"))
    both = inside(a, ends(b, "b"), "b").unionByName(inside(b, ends(a, "a"), "a"))
    return both.groupBy("feature").agg(F.avg("in").alias("similarity"))


def drifted(distance: float, r_old: float, r_new: float) -> bool:
    return distance >= r_old + r_new
