"""Marginals, latents and conditional means of the masked event stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftloom.functions import numeric as n
from driftloom.operators import copula, frames
from driftloom.operators.lineage import cut
from driftloom.plans.registry import register
from driftloom.plans.tables import FEATURES, MASKED, masked_long, matrix

ORDINAL = [2, 3]


@register("ring_window", f"WITH {MASKED}, r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY row_id DESC) AS slot FROM k WHERE value IS NOT NULL) SELECT feature_id, row_id, slot, round(value, 6) AS value FROM r WHERE slot <= 50")
def ring_window(spark, sf_dir):
    """The last fifty observed values of each column."""
    r = copula.ring(masked_long(spark, sf_dir), 50)
    return r.select("feature_id", "row_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


@register("ring_window_sparse", f"""WITH {MASKED}, b AS (SELECT *, max(row_id) OVER (PARTITION BY row_id // 100) AS last FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY row_id DESC) AS slot FROM b WHERE (row_id < 100 OR row_id = last) AND value IS NOT NULL)
SELECT feature_id, row_id FROM r WHERE slot <= 20""")  # fmt: skip
def ring_window_sparse(spark, sf_dir):
    """Only each batch's last row enters."""
    return copula.ring_last_of_batch(masked_long(spark, sf_dir), 100, 20).select("feature_id", "row_id")


@register("empirical_distribution", f"WITH {MASKED} SELECT row_id, feature_id, round(cume_dist() OVER (PARTITION BY feature_id ORDER BY value), 6) AS \"F\" FROM k WHERE value IS NOT NULL")
def empirical_distribution(spark, sf_dir):
    """The share of values that are no larger."""
    return copula.ecdf(masked_long(spark, sf_dir)).select("row_id", "feature_id", F.round("F", 6).alias("F"))


_Z = MASKED + f""", e AS (SELECT row_id, feature_id, value, cume_dist() OVER (PARTITION BY feature_id ORDER BY value) AS f, count(*) OVER (PARTITION BY feature_id) AS c FROM k WHERE value IS NOT NULL AND feature_id < 2),
z AS (SELECT row_id, feature_id, {n.norm_ppf('(f * c / (c + 1))')} AS z FROM e)"""


@register("continuous_latents", f"WITH {_Z} SELECT row_id, feature_id, round(z, 6) AS z FROM z")
def continuous_latents(spark, sf_dir):
    """Normal scores of the continuous columns."""
    return copula.continuous_latent(masked_long(spark, sf_dir).where("feature_id < 2")).select("row_id", "feature_id", F.round("z", 6).alias("z"))


@register("ordinal_latents", f"""WITH {MASKED}, c AS (SELECT feature_id, value, count(*) AS n FROM k WHERE value IS NOT NULL AND feature_id > 1 GROUP BY ALL),
s AS (SELECT feature_id, value, (sum(n) OVER w - n) / sum(n) OVER (PARTITION BY feature_id) AS a, sum(n) OVER w / sum(n) OVER (PARTITION BY feature_id) AS b FROM c WINDOW w AS (PARTITION BY feature_id ORDER BY value))
SELECT feature_id, value, round({n.norm_ppf('a')}, 6) AS lo, round({n.norm_ppf('b')}, 6) AS hi, round({n.norm_ppf('((a + b) / 2)')}, 6) AS z FROM s""")  # fmt: skip
def ordinal_latents(spark, sf_dir):
    """The latent interval of each level, and the middle of its mass."""
    b = copula.ordinal_bounds(masked_long(spark, sf_dir).where("feature_id > 1"))
    return b.select("feature_id", "value", *(F.round(c, 6).alias(c) for c in ("lo", "hi", "z")))


_RHO = f"""WITH {_Z}, w AS (SELECT row_id, max(z) FILTER (WHERE feature_id = 0) AS a, max(z) FILTER (WHERE feature_id = 1) AS b FROM z GROUP BY row_id)"""


@register("pair_expectation", _RHO + " SELECT row_id, round(0.5 * coalesce(a, b), 6) AS missing_z FROM w")
def pair_expectation(spark, sf_dir):
    """G7, G8 for two columns: the missing latent of each pair at correlation one half, from the general step."""
    cells = copula.latent(masked_long(spark, sf_dir).where("feature_id < 2"), [])
    rows = copula.rows_of(cells, 2)
    sigma = np.array([[1.0, 0.5], [0.5, 1.0]])
    x = copula.expectation(rows, sigma)
    seen = rows.select("row_id", F.col("z")[0].isNull().alias("first_gone"))
    return x.join(seen, "row_id").select("row_id", F.round(F.when(F.col("first_gone"), F.col("x")[0]).otherwise(F.col("x")[1]), 6).alias("missing_z"))


@register("copula_matrix")
def copula_matrix(spark, sf_dir):
    """The latent correlations after batch EM."""
    rows = copula.rows_of(copula.latent(masked_long(spark, sf_dir), ORDINAL), 4)
    sigma = copula.fit(cut(rows), 4)
    return spark.createDataFrame([(i, j, float(sigma[i, j])) for i in range(4) for j in range(4)], "i int, j int, rho double")


@register("copula_imputed")
def copula_imputed(spark, sf_dir):
    """The stream with its missing cells filled after online EM over all batches of 500."""
    cells = masked_long(spark, sf_dir)
    rows = copula.rows_of(copula.latent(cells, ORDINAL), 4)
    sigma = copula.fit_batches(rows, 4, 500)
    return copula.impute(cells, ORDINAL, 4, sigma)


@register("copula_imputed_shares")
def copula_imputed_shares(spark, sf_dir):
    """The same after online EM over ten shares of the stream, each of which the whole cluster takes."""
    cells = masked_long(spark, sf_dir)
    sigma = copula.fit_shares(copula.rows_of(copula.latent(cells, ORDINAL), 4), 4, 10)
    return copula.impute(cells, ORDINAL, 4, sigma)


@register("copula_change")
def copula_change(spark, sf_dir):
    """Whether the correlations changed from each batch of 500 to the next."""
    rows = copula.rows_of(copula.latent(masked_long(spark, sf_dir), ORDINAL), 4)
    return copula.batch_changes(rows, 4, 500)


@register("copula_stream")
def copula_stream(spark, sf_dir):
    """Four streams filled along their way, by the last 200 values of each column and batches of 50."""
    rows = matrix(spark, sf_dir).select((F.col("user_id") % 4).alias("stream"), "row_id", frames.mask_pairs(F.array(*FEATURES), F.col("row_id")).alias("x"))
    return copula.impute_stream(rows, "stream", "row_id", "x", ORDINAL, 200, 50).select("key", "row_id", F.posexplode("values").alias("feature_id", "value"))


@register("copula_trapezoid")
def copula_trapezoid(spark, sf_dir):
    """The same where columns appear one after the other, and only each batch's last row enters the windows."""
    rows = matrix(spark, sf_dir).select((F.col("user_id") % 4).alias("stream"), "row_id", frames.mask_pairs(F.array(*FEATURES), F.col("row_id")).alias("x"))
    shown = rows.withColumn("x", frames.trapezoid(F.col("x"), F.col("row_id"), F.lit(rows.count())))
    return copula.impute_stream(shown, "stream", "row_id", "x", ORDINAL, 200, 50, last_only=True).select("key", "row_id", F.posexplode("values").alias("feature_id", "value"))


@register("copula_stream_change")
def copula_stream_change(spark, sf_dir):
    """G12 along the stream: how each batch's correlations differ from those carried so far, which sets the decay after it."""
    rows = matrix(spark, sf_dir).select((F.col("user_id") % 4).alias("stream"), "row_id", frames.mask_pairs(F.array(*FEATURES), F.col("row_id")).alias("x"))
    tested = copula.impute_stream(rows, "stream", "row_id", "x", ORDINAL, 200, 50, samples=100, level=0.01)
    return tested.select("key", "row_id", "p_change")
