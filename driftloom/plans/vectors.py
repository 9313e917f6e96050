"""Kernels and large-margin learners on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import numeric as n
from driftloom.operators import svm
from driftloom.plans.registry import register
from driftloom.plans.tables import table

_K = "WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), m AS (SELECT label, [" + ", ".join(f"avg(x[{i}])" for i in range(1, 65)) + "] AS c FROM p GROUP BY label)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _centres(spark, sf_dir):
    """The mean of each label: ten rows."""
    v = _vectors(spark, sf_dir)
    return v.groupBy(F.col("label").alias("centre")).agg(F.array(*(F.avg(F.col("x")[i]) for i in range(64))).alias("c"))


@register("rbf_kernel", _K + " SELECT vec_id, m.label AS centre, round(exp(-list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) ** 2)) / (2 * 0.5 * 0.5)), 6) AS k FROM p, m")
def rbf_kernel(spark, sf_dir):
    """radial kernel of each vector with each label's centre, gathered in one small array."""
    few = _centres(spark, sf_dir).agg(F.collect_list(F.struct("centre", "c")).alias("all")).scalar()
    both = _vectors(spark, sf_dir).select("vec_id", "x", F.inline(few).alias("centre", "c"))
    return both.select("vec_id", "centre", F.round(n.rbf_kernel(F.col("x"), F.col("c"), 0.5), 6).alias("k"))


@register("linear_kernel", _K + " SELECT vec_id, m.label AS centre, round(list_sum(list_transform(list_zip(x, c), lambda z: z[1] * z[2])), 6) AS k FROM p, m")
def linear_kernel(spark, sf_dir):
    """Inner products with the centres."""
    few = _centres(spark, sf_dir).agg(F.collect_list(F.struct("centre", "c")).alias("all")).scalar()
    both = _vectors(spark, sf_dir).select("vec_id", "x", F.inline(few).alias("centre", "c"))
    return both.select("vec_id", "centre", F.round(n.dot(F.col("x"), F.col("c")), 6).alias("k"))


_MAPS = """WITH s AS (SELECT user_id, map_from_entries(list((event_type, v))) AS x FROM (SELECT user_id, event_type, sum(value) / 1000 AS v FROM events GROUP BY ALL) GROUP BY user_id),
c AS (SELECT map_from_entries(list((event_type, v))) AS c FROM (SELECT event_type, avg(value) / 100 AS v FROM events WHERE event_type <> 'view' GROUP BY event_type))"""
_DOT = "list_sum(list_transform(map_keys(x), lambda k: coalesce(x[k], 0) * coalesce(c[k], 0)))"
_SQUARE = "list_sum(list_transform(map_values({m}), lambda v: v * v))"


@register("sparse_kernels", f"{_MAPS} SELECT user_id, round({_DOT}, 6) AS linear, round(exp(-({_SQUARE.format(m='x')} + {_SQUARE.format(m='c')} - 2 * {_DOT}) / 2), 6) AS rbf FROM s, c")
def sparse_kernels(spark, sf_dir):
    """F8, F12 on maps: kernels of each user's sums by event type with the average of all but one type."""
    events = table(spark, sf_dir, "events")
    entries = lambda v: F.map_from_entries(F.collect_list(F.struct("event_type", v)))
    users = events.groupBy("user_id", "event_type").agg((F.sum("value") / 1000).alias("v")).groupBy("user_id").agg(entries("v").alias("x"))
    mean = events.where("event_type <> 'view'").groupBy("event_type").agg((F.avg("value") / 100).alias("v")).agg(entries("v").alias("c")).scalar()
    both = users.select("user_id", "x", mean.alias("c"))
    return both.select("user_id", F.round(n.sparse_dot(F.col("x"), F.col("c")), 6).alias("linear"), F.round(n.sparse_rbf_kernel(F.col("x"), F.col("c"), 1.0), 6).alias("rbf"))


@register("linear_svm_grid")
def linear_svm_grid(spark, sf_dir):
    """The best of six costs, learned on seven rows of ten."""
    v = _vectors(spark, sf_dir).withColumn("y", (F.col("label") < 5).cast("int"))
    return svm.linear_grid(v.where("vec_id % 10 < 7"), v.where("vec_id % 10 >= 7"), "x", "y")


@register("transductive_svm")
def transductive_svm(spark, sf_dir):
    """One label in four is known."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), (F.col("label") < 5).cast("int").alias("y"))
    known = v.withColumn("known", F.when(F.col("vec_id") % 4 == 0, F.col("y")))
    model = svm.TransductiveSVM().fit(known, "x", "known")
    return model.predict(v, "x").select("vec_id", "y", "predicted", "probability")


@register("transductive_svm_sparse")
def transductive_svm_sparse(spark, sf_dir):
    """The same on maps of the components that stand out."""
    few = F.map_filter(F.map_from_arrays(F.sequence(F.lit(0), F.size("embedding") - 1), F.col("embedding").cast("array<double>")), lambda _, v: F.abs(v) > 0.1)
    v = table(spark, sf_dir, "embeddings").select("vec_id", few.alias("x"), (F.col("label") < 5).cast("int").alias("y"))
    known = v.withColumn("known", F.when(F.col("vec_id") % 4 == 0, F.col("y")))
    return svm.TransductiveSVM().fit(known, "x", "known").predict(v, "x").select("vec_id", "y", "predicted", "probability")


@register("transductive_svm_radial")
def transductive_svm_radial(spark, sf_dir):
    """The same with a radial kernel over a basis of at most 200 vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), (F.col("label") < 5).cast("int").alias("y"))
    known = v.withColumn("known", F.when(F.col("vec_id") % 4 == 0, F.col("y")))
    return svm.TransductiveSVM(kernel="rbf").fit(known, "x", "known").predict(v, "x").select("vec_id", "y", "predicted", "probability")


@register("subspace_distance")
def subspace_distance(spark, sf_dir):
    """The leading subspaces of the embeddings' correlations, labels below five against the others, and against a random correlation matrix."""
    v = _vectors(spark, sf_dir)
    low, high = (svm.correlation(v.where(c), "x") for c in ("label < 5", "label >= 5"))
    drawn = svm.random_correlation(len(low), seed=1)
    rows = [(name, *svm.grassmann(low, other, 3)) for name, other in (("others", high), ("random", drawn))]
    return spark.createDataFrame(rows, "against string, angle double, gap double")
