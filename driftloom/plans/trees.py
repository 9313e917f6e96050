"""Split search and trees over the event stream and the orders' categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import trees as t
from driftloom.plans.registry import register
from driftloom.plans.tables import FEATURES, LONG, MATRIX, matrix, table

_G = lambda a, b: f"(CASE WHEN {a} + {b} > 0 THEN 1 - pow(({a}) / ({a} + {b}), 2) - pow(({b}) / ({a} + {b}), 2) ELSE 0 END)"
_COUNTS = f"WITH {LONG}, c AS (SELECT feature_id, value, (count(*) FILTER (WHERE label = 0))::DOUBLE AS n0, (count(*) FILTER (WHERE label = 1))::DOUBLE AS n1 FROM l JOIN m USING (row_id) GROUP BY ALL)"
_SPLITS = _COUNTS + f""", s AS (SELECT feature_id, value, sum(n0) OVER u AS l0, sum(n1) OVER u AS l1, sum(n0) OVER p AS t0, sum(n1) OVER p AS t1, lead(value) OVER u AS nxt FROM c
  WINDOW p AS (PARTITION BY feature_id), u AS (PARTITION BY feature_id ORDER BY value)),
g AS (SELECT feature_id, (value + nxt) / 2 AS cut, {_G('l0', 'l1')} * (l0 + l1) / (t0 + t1) + {_G('(t0 - l0)', '(t1 - l1)')} * (t0 + t1 - l0 - l1) / (t0 + t1) AS g, {_G('t0', 't1')} AS root, t0 + t1 AS n FROM s WHERE nxt IS NOT NULL)"""


def _counts(spark, sf_dir):
    m = matrix(spark, sf_dir)
    cells = F.inline(F.array(*(F.struct(F.lit(i).alias("feature_id"), F.col(f).alias("value")) for i, f in enumerate(FEATURES))))
    return t.class_counts(m.select("label", cells), [])


@register("numeric_splits", _SPLITS + " SELECT feature_id, round(cut, 6) AS cut, round(g, 6) AS g FROM g")
def numeric_splits(spark, sf_dir):
    """The weighted Gini of every midpoint."""
    return t.numeric_splits(_counts(spark, sf_dir), []).select("feature_id", F.round("cut", 6).alias("cut"), F.round("g", 6).alias("g"))


@register("best_split", _SPLITS + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY g, cut) AS r FROM g) WHERE r = 1),
o AS (SELECT *, row_number() OVER (ORDER BY g, feature_id) AS k, lead(g) OVER (ORDER BY g, feature_id) AS second FROM b)
SELECT feature_id, round(g, 6) AS g, round(second, 6) AS second, n >= 20 AND g < root AND (second - g > sqrt(ln(1000.0) / (2 * n)) OR (second - g < sqrt(ln(1000.0) / (2 * n)) AND sqrt(ln(1000.0) / (2 * n)) < 0.5)) AS splits FROM o WHERE k = 1""")  # fmt: skip
def best_split(spark, sf_dir):
    """The best split, the second best, and whether the difference is certain."""
    b = t.best_splits(t.numeric_splits(_counts(spark, sf_dir), []), [])
    return b.select("feature_id", F.round("g", 6).alias("g"), F.round("second", 6).alias("second"), t.accepts().alias("splits"))


_ORDERS = "WITH c AS (SELECT {v} AS value, (count(*) FILTER (WHERE o_totalprice <= 250000))::DOUBLE AS n0, (count(*) FILTER (WHERE o_totalprice > 250000))::DOUBLE AS n1 FROM orders GROUP BY ALL)"


def _category_counts(spark, sf_dir, value):
    o = table(spark, sf_dir, "orders").select(F.lit(0).alias("feature_id"), value.alias("value"), (F.col("o_totalprice") > 250000).cast("int").alias("label"))
    return t.class_counts(o, [])


@register("category_splits", _ORDERS.format(v="o_custkey % 40") + f", s AS (SELECT *, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1 FROM c) SELECT 0 AS feature_id, value, round({_G('n0', 'n1')} * (n0 + n1) / (t0 + t1) + {_G('(t0 - n0)', '(t1 - n1)')} * (t0 + t1 - n0 - n1) / (t0 + t1), 6) AS g FROM s")
def category_splits(spark, sf_dir):
    """H4: each of many categories against the rest."""
    return t.one_against_rest(_category_counts(spark, sf_dir, F.col("o_custkey") % 40), []).select("feature_id", "value", F.round("g", 6).alias("g"))


@register("subset_splits", _ORDERS.format(v="o_orderpriority") + f""", n AS (SELECT *, row_number() OVER (ORDER BY value) - 1 AS i, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1, count(*) OVER () AS k FROM c),
x AS (SELECT mask, string_agg(value, ',' ORDER BY value) AS members, sum(n0) AS a0, sum(n1) AS a1, max(t0) AS t0, max(t1) AS t1 FROM n, range(1, 16) r(mask) WHERE (mask >> i) % 2 = 1 GROUP BY mask)
SELECT members, round({_G('a0', 'a1')} * (a0 + a1) / (t0 + t1) + {_G('(t0 - a0)', '(t1 - a1)')} * (t0 + t1 - a0 - a1) / (t0 + t1), 6) AS g FROM x""")  # fmt: skip
def subset_splits(spark, sf_dir):
    """H4: all subsets of few categories."""
    s = t.subset_splits(_category_counts(spark, sf_dir, F.col("o_orderpriority")), [])
    return s.select(F.array_join("members", ",").alias("members"), F.round("g", 6).alias("g"))


_TREE = t.Node()
_TREE.split(3, None, (0.0, 2.0))
_TREE.left.split(0, 20.0, None)
_TREE.right.split(1, 60.0, None)


@register("tree_routed", f"""WITH {MATRIX}, r AS (SELECT *, CASE WHEN f3 IN (0, 2) THEN CASE WHEN f0 <= 20 THEN 4 ELSE 5 END ELSE CASE WHEN f1 <= 60 THEN 6 ELSE 7 END END AS node FROM m),
k AS (SELECT node, CAST(2 * count(*) FILTER (WHERE label = 1) > count(*) AS INT) AS main FROM r WHERE row_id % 2 = 0 GROUP BY node)
SELECT row_id, node, coalesce(main, 0) AS predicted FROM r LEFT JOIN k USING (node)""")  # fmt: skip
def tree_routed(spark, sf_dir):
    """H1, H2, H7: a given tree, by members of a category and by cuts, routes the stream; leaves say what most of their rows with a known label are."""
    m = matrix(spark, sf_dir)
    t.name_leaves(_TREE, m.where("row_id % 2 = 0"), FEATURES, "label")
    return m.select("row_id", t.node_id(_TREE, FEATURES).alias("node"), t.predict(_TREE, FEATURES).alias("predicted"))


@register("tree_predictions")
def tree_predictions(spark, sf_dir):
    """H1, H5: a batch tree grown level by level on the labelled rows of the whole table predicts the stream."""
    m = matrix(spark, sf_dir).withColumn("known", F.when(F.col("row_id") % 2 == 0, F.col("label")))
    tree = t.grow(m, FEATURES, "known")
    return m.select("row_id", "label", t.node_id(tree, FEATURES).alias("node"), t.predict(tree, FEATURES).alias("predicted"))


@register("tree_stream")
def tree_stream(spark, sf_dir):
    """The tree along the stream in five micro-batches, half of the labels missing; what it predicts at the end."""
    m = matrix(spark, sf_dir).withColumn("known", F.when(F.col("row_id") % 2 == 0, F.col("label")))
    size = m.agg(F.max("row_id")).first()[0] // 5 + 1
    tree = t.StreamTree("row_id", FEATURES[:2], FEATURES[2:], "known")
    for j in range(5):
        tree.update(m.where(F.col("row_id").between(j * size, (j + 1) * size - 1)))
    return tree.predict(m).select("row_id", "label", "node", "predicted")


@register("tree_ensemble")
def tree_ensemble(spark, sf_dir):
    """Batch trees over two views of the stream, joined by either; the incremental ones are in two_space_labels."""
    m = matrix(spark, sf_dir).withColumn("known", F.when(F.col("row_id") % 2 == 0, F.col("label")))
    a, b = t.grow(m, FEATURES[:2], "known"), t.grow(m, FEATURES[2:], "known")
    return m.select("row_id", "label", t.either(t.predict(a, FEATURES[:2]), t.predict(b, FEATURES[2:])).alias("predicted"))
