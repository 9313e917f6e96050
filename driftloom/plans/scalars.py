"""Numeric functions and aggregates on table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import numeric as n
from driftloom.operators import order
from driftloom.plans.registry import register
from driftloom.plans.tables import LONG, MASKED, MATRIX, long, masked_long, matrix

_FUNCTIONS = {
    "ppf": n.norm_ppf("((f1 + 0.5E0) / 100)"), "cdf": n.norm_cdf("((f0 - 50) / 20)"), "pdf": n.norm_pdf("((f0 - 50) / 20)"), "sigmoid": n.sigmoid("((f0 - 50) / 5)"),
    "loss": n.logistic_loss("label", "((f0 - 50) / 5)"), "loss2": n.log2_loss("label", "((f1 + 0.5E0) / 100)"), "bound": n.hoeffding_bound("2.0E0", "0.001E0", "(f1 + 1)"),
    "gini": n.gini(["f2", "f3"]), "lomax": n.lomax_log_pdf("f0", "1.5E0", "3.0E0"), "decay0": n.decay(0, "(f1 + 1)"), "decay4": n.decay(4, "(f1 + 1)"),
    "cut_mean": n.truncated_mean("0.0E0", "1.0E0", "(f2 / 10 - 1)", "(f2 / 10 + f3 / 5 + 0.1E0)"), "cut_var": n.truncated_variance("0.0E0", "1.0E0", "(f2 / 10 - 1)", "(f2 / 10 + f3 / 5 + 0.1E0)"),
}
for _name, _text in _FUNCTIONS.items():

    def _query(spark, sf_dir, text=_text):
        return matrix(spark, sf_dir).select("row_id", F.round(n.col(text), 6).alias("x"))

    _query.__doc__ = f"{_name} of each event."
    register(f"fn_{_name}", f"WITH {MATRIX} SELECT row_id, round({_text}, 6) AS x FROM m")(_query)


@register("pooled_moments", f"WITH {MASKED} SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM k WHERE feature_id < 2")
def pooled_moments(spark, sf_dir):
    """A2: mean and deviation of the observed cells of all continuous columns."""
    return masked_long(spark, sf_dir).where("feature_id < 2").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@register("column_summary", f"""WITH {MASKED} SELECT feature_id, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median,
  round((max(value) - min(value)) / nullif(max(value), 0), 6) AS spread FROM k GROUP BY feature_id""")  # fmt: skip
def column_summary(spark, sf_dir):
    """Ends, quartile and median of each column."""
    cells = masked_long(spark, sf_dir)
    ends = cells.groupBy("feature_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    both = ends.join(order.quantiles(cells, "feature_id", "value", [0.25, 0.5]), "feature_id", "left")
    spread = F.try_divide(F.col("hi") - F.col("lo"), F.col("hi"))
    return both.select("feature_id", "lo", "hi", F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[1], 6).alias("median"), F.round(spread, 6).alias("spread"))


_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


@register("covariances", f"WITH {MATRIX} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_samp(f{i}, f{j}), 4) AS cov, round(covar_samp(f{i}, f{j}) / (stddev_samp(f{i}) * stddev_samp(f{j})), 6) AS rho FROM m" for i, j in _PAIRS))
def covariances(spark, sf_dir):
    """All covariances in one partial aggregation, correlations from them."""
    cov = lambda i, j: F.covar_samp(f"f{i}", f"f{j}")
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), cov(i, j).alias("c"), F.sqrt(cov(i, i) * cov(j, j)).alias("s")) for i, j in _PAIRS]
    one = matrix(spark, sf_dir).agg(F.array(*cells).alias("cells"))
    return one.select(F.inline("cells")).select("i", "j", F.round("c", 4).alias("cov"), F.round(F.col("c") / F.col("s"), 6).alias("rho"))


@register("cell_class_counts", f"WITH {LONG} SELECT feature_id, value, label, count(*) AS n FROM l JOIN m USING (row_id) WHERE feature_id > 1 GROUP BY ALL")
def cell_class_counts(spark, sf_dir):
    """How often each value meets each class."""
    m = matrix(spark, sf_dir)
    cells = F.inline(F.array(*(F.struct(F.lit(i).alias("feature_id"), F.col(f"f{i}").alias("value")) for i in (2, 3))))
    return m.select("label", cells).groupBy("feature_id", "value", "label").agg(F.count("*").alias("n"))


@register("column_modes", f"WITH {LONG}, c AS (SELECT feature_id, value, count(*) AS n FROM l GROUP BY ALL) SELECT feature_id, value AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY n DESC, value) AS r FROM c) WHERE r = 1")
def column_modes(spark, sf_dir):
    """A1: each column's most frequent value, the smallest among equals."""
    c = long(spark, sf_dir).groupBy("feature_id", "value").agg(F.count("*").alias("n"))
    best = c.groupBy("feature_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
    return best.select("feature_id", F.col("b.value").alias("mode"), (-F.col("b.m")).alias("n"))


_TEST = f"WITH {MASKED}, e AS (SELECT feature_id, l.row_id, l.value AS true_, k.value AS obs FROM l JOIN k USING (row_id, feature_id)), g AS (SELECT feature_id, avg(obs) AS mean, median(obs) AS med FROM e GROUP BY feature_id), t AS (SELECT e.*, mean AS imp, med FROM e JOIN g USING (feature_id))"


def _imputed(spark, sf_dir):
    """Every cell with its true, observed and mean-imputed value, and its column's median."""
    m = masked_long(spark, sf_dir).withColumnRenamed("value", "obs")
    both = long(spark, sf_dir).withColumnRenamed("value", "true_").join(m, ["row_id", "feature_id"])
    middle = order.quantiles(m, "feature_id", "obs", [0.5]).select("feature_id", F.col("q")[0].alias("med"))
    stats = m.groupBy("feature_id").agg(F.avg("obs").alias("imp")).join(middle, "feature_id", "left")
    return both.join(F.broadcast(stats), "feature_id")


@register("imputation_errors", _TEST + """ SELECT feature_id, round(avg(abs(imp - true_)), 6) AS mae_all, round(avg(abs(imp - true_)) FILTER (WHERE obs IS NULL), 6) AS mae, round(sum(abs(imp - true_)) FILTER (WHERE obs IS NULL) / sum(abs(med - true_)) FILTER (WHERE obs IS NULL), 6) AS smae,
  round(sqrt(avg((imp - true_) * (imp - true_))), 6) AS rmse, round(sqrt(sum((imp - true_) * (imp - true_)) FILTER (WHERE obs IS NULL)) / sqrt(sum(true_ * true_) FILTER (WHERE obs IS NULL)), 6) AS rel FROM t GROUP BY feature_id""")  # fmt: skip
def imputation_errors(spark, sf_dir):
    """Errors of imputing the mean, over all cells and over the masked ones."""
    gone, d = F.col("obs").isNull(), F.col("imp") - F.col("true_")
    only = lambda x: F.when(gone, x)
    return _imputed(spark, sf_dir).groupBy("feature_id").agg(
        F.round(F.avg(F.abs(d)), 6).alias("mae_all"), F.round(F.avg(only(F.abs(d))), 6).alias("mae"),
        F.round(F.sum(only(F.abs(d))) / F.sum(only(F.abs(F.col("med") - F.col("true_")))), 6).alias("smae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"),
        F.round(F.sqrt(F.sum(only(d * d))) / F.sqrt(F.sum(only(F.col("true_") * F.col("true_")))), 6).alias("rel"),
    )


@register("imputation_errors_by_kind", _TEST + " SELECT CASE WHEN feature_id < 2 THEN 'continuous' ELSE 'ordinal' END AS kind, round(sum(abs(imp - true_)) / sum(abs(med - true_)), 6) AS smae FROM t WHERE obs IS NULL GROUP BY ALL")
def imputation_errors_by_kind(spark, sf_dir):
    """The same for all columns of a kind."""
    kind = F.when(F.col("feature_id") < 2, "continuous").otherwise("ordinal").alias("kind")
    d = lambda c: F.sum(F.abs(F.col(c) - F.col("true_")))
    return _imputed(spark, sf_dir).where("obs is null").groupBy(kind).agg(F.round(d("imp") / d("med"), 6).alias("smae"))
