"""The whole experiment along a stream: both spaces, trees in each, learners over both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators import copula, frames, online
from driftloom.operators import trees as t
from driftloom.operators.lineage import stored
from driftloom.plans.imputation import ORDINAL
from driftloom.plans.registry import register
from driftloom.plans.tables import FEATURES, matrix

STREAMS, WINDOW, BATCH, MICRO_BATCHES = 4, 200, 50, 5
X, Z = [f"x{i}" for i in range(4)], [f"z{i}" for i in range(4)]


def both_spaces(spark, sf_dir: str) -> DataFrame:
    """(key, row_id, x0..x3, z0..z3, x, label, known): four masked streams imputed along their way; half of the labels are known."""
    m = matrix(spark, sf_dir)
    rows = m.select((F.col("user_id") % STREAMS).alias("stream"), "row_id", "label", frames.mask_pairs(F.array(*FEATURES), F.col("row_id")).alias("x"))
    rows = rows.withColumn("known", F.when(F.col("row_id") % 2 == 0, F.col("label")))
    filled = copula.impute_stream(rows, "stream", "row_id", "x", ORDINAL, WINDOW, BATCH, carry=("x", "label", "known"))
    values = [F.get("values", F.lit(i)).alias(c) for i, c in enumerate(X)]
    return filled.select("key", "row_id", *values, *(F.get("latents", F.lit(i)).alias(c) for i, c in enumerate(Z)), "x", "label", "known")


def two_trees() -> t.TwoSpaces:
    """Over the values, of which two are categories, and over the latents, a unit of which has five ranges."""
    return t.TwoSpaces(t.StreamTree("row_id", X[:2], X[2:], "known"), t.StreamTree("row_id", Z, [], "known", width=0.2))


def labelled(spark, sf_dir: str) -> DataFrame:
    """:func:`both_spaces` with predicted_x, predicted_z and predicted, each batch before it was learned from."""
    rows = stored(both_spaces(spark, sf_dir), "row_id")
    last = rows.agg(F.max("row_id")).first()[0]
    size = (last or 0) // MICRO_BATCHES + 1
    trees, out = two_trees(), None
    for j in range(MICRO_BATCHES):
        said = trees.step(rows.where(F.col("row_id").between(j * size, (j + 1) * size - 1)))
        out = said if out is None else out.unionByName(said)
    return out


@register("two_space_stream")
def two_space_stream(spark, sf_dir):
    """Each row's values and latents, aligned."""
    return both_spaces(spark, sf_dir).drop("x")


@register("two_space_labels")
def two_space_labels(spark, sf_dir):
    """H8, H9: labels by incremental trees in each space and by either, batch by batch."""
    return labelled(spark, sf_dir).select("key", "row_id", "label", "known", "predicted_x", "predicted_z", "predicted")


#: What learners see and are told: the zero-filled values or the latents; the known labels, or the trees' where unknown.
VARIANTS = {"x_known": ("x", None), "z_known": ("z", None), "x_filled": ("x", "predicted_x"), "z_filled": ("z", "predicted_z"), "x_either": ("x", "predicted"), "z_either": ("z", "predicted")}


@register("two_space_learners")
def two_space_learners(spark, sf_dir):
    """O6, O8, O9, W1, W10 over both spaces: every variant's prediction of every row, those of both spaces joined by weight, and the error so far."""
    rows = labelled(spark, sf_dir)
    bias = F.array(F.lit(1.0))
    seen = {"x": F.concat(bias, F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))), "z": F.concat(bias, *(F.array(F.coalesce(c, F.lit(0.0))) for c in Z))}
    told = lambda c: F.coalesce("known", c) if c else F.col("known")
    each = F.array(*(F.struct(F.lit(name).alias("variant"), seen[space].alias("seen"), told(c).alias("told")) for name, (space, c) in VARIANTS.items()))
    long = rows.select("key", "row_id", "label", F.inline(each))
    long = long.withColumn("stream", F.struct("variant", "key"))
    said = stored(online.replay(long, "stream", "row_id", "seen", "label", "told"), "row_id")

    def mixed(name: str, x: str, z: str) -> DataFrame:
        one = lambda v: said.where(F.col("key.variant") == v).withColumn("key", F.struct(F.lit(name).alias("variant"), F.col("key.key").alias("key")))
        return online.ensemble(one(x), one(z)).select("key", "row_id", "y", "p")

    both = said.select("key", "row_id", "y", "p").unionByName(mixed("xz_known", "x_known", "z_known")).unionByName(mixed("xz_filled", "x_filled", "z_filled"))
    w = Window.partitionBy("key").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.select(F.col("key.variant").alias("variant"), F.col("key.key").alias("key"), "row_id", "p", online.cer(F.col("y"), F.col("p"), w).alias("cer"))
