"""k-modes over categorical columns of the line items' parts, and drift between cluster sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import clusters as c
from driftloom.plans.registry import register
from driftloom.plans.tables import MATRIX, draw, matrix

_START = [("0", "0", "signup"), ("5", "2", "other"), ("9", "4", "signup")]
_X = MATRIX + ", x AS (SELECT row_id, label, CAST(CAST(f2 AS INT) AS VARCHAR) AS a, CAST(CAST(f3 AS INT) AS VARCHAR) AS b, CASE WHEN label = 1 THEN 'signup' ELSE 'other' END AS c FROM m)"


def _ham(cs: list[tuple[str, str, str]]) -> str:
    one = lambda k: " + ".join(f"CAST({col} <> '{v}' AS INT)" for col, v in zip("abc", k, strict=True))
    return "[" + ", ".join(one(k) for k in cs) + "]"


_ASSIGN = f"WITH {_X}, d AS (SELECT *, {_ham(_START)} AS ds FROM x), s AS (SELECT *, list_position(ds, list_min(ds)) - 1 AS cluster, list_min(ds) AS mismatches FROM d)"
_MODES = _ASSIGN + """, cell AS (SELECT cluster, 0 AS feature, a AS value FROM s UNION ALL SELECT cluster, 1, b FROM s UNION ALL SELECT cluster, 2, c FROM s),
cnt AS (SELECT cluster, feature, value, count(*) AS n FROM cell GROUP BY ALL), mo AS (SELECT cluster, feature, value AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster, feature ORDER BY n DESC, value) AS r FROM cnt) WHERE r = 1)"""


def _rows(spark, sf_dir):
    text = lambda x: F.col(x).cast("int").cast("string")
    return matrix(spark, sf_dir).select("row_id", "label", F.array(text("f2"), text("f3"), F.when(F.col("label") == 1, "signup").otherwise("other")).alias("x"))


@register("modes_assigned", _ASSIGN + " SELECT row_id, cluster, mismatches FROM s")
def modes_assigned(spark, sf_dir):
    """The nearest of three centres."""
    return c.assign_modes(_rows(spark, sf_dir), _START).select("row_id", "cluster", "mismatches")


@register("modes_updated", _MODES + " SELECT cluster, feature, mode, n FROM mo")
def modes_updated(spark, sf_dir):
    """K2, A1: the clusters' new centres."""
    return c.modes(c.assign_modes(_rows(spark, sf_dir), _START))


def _rounds_sql(start: str, rounds: int = 20) -> str:
    """Twenty rounds of assignment and new modes from the centres (k, a, b, c) of ``start``; rounds after the last change change nothing."""
    near = lambda r: f"(SELECT row_id, x.a, x.b, x.c, x.label, arg_min(k, 10 * ((x.a <> z.a)::INT + (x.b <> z.b)::INT + (x.c <> z.c)::INT) + k) AS k FROM x, c{r} z GROUP BY ALL)"
    out = f"WITH {_X}, c0 AS MATERIALIZED ({start})"
    for r in range(rounds):
        cells = " UNION ALL ".join(f"SELECT k, '{f}' AS f, {f} AS v FROM a{r}" for f in "abc")
        pick = ", ".join(f"coalesce((SELECT v FROM m{r} WHERE m{r}.k = z.k AND f = '{f}'), z.{f}) AS {f}" for f in "abc")
        out += f""",
a{r} AS MATERIALIZED {near(r)},
m{r} AS MATERIALIZED (SELECT k, f, v FROM (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY n DESC, v) AS o FROM (SELECT k, f, v, count(*) AS n FROM ({cells}) GROUP BY ALL)) WHERE o = 1),
c{r + 1} AS MATERIALIZED (SELECT k, {pick} FROM c{r} z)"""
    return out + f", fin AS MATERIALIZED {near(rounds)}"


_FIRST = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(_START)) + ") t(k, a, b, c)"


@register("k_modes", _rounds_sql(_FIRST) + " SELECT k AS cluster, count(*) AS n FROM fin GROUP BY k")
def k_modes(spark, sf_dir):
    """K2: rounds until the centres stay."""
    return c.k_modes(_rows(spark, sf_dir), _START)[0].groupBy("cluster").agg(F.count("*").alias("n"))


@register("cluster_purity", _ASSIGN + ", k AS (SELECT cluster, label, count(*) AS n FROM s GROUP BY ALL) SELECT round(sum(m) / sum(t), 6) AS purity FROM (SELECT max(n) AS m, sum(n) AS t FROM k GROUP BY cluster)")
def cluster_purity(spark, sf_dir):
    """K3: the share of rows that belong to their cluster's main class."""
    return c.purity(c.assign_modes(_rows(spark, sf_dir), _START)).select(F.round("purity", 6).alias("purity"))


@register("repaired_labels", _ASSIGN + """, h AS (SELECT row_id, cluster, CASE WHEN row_id % 3 = 0 THEN label END AS label FROM s), k AS (SELECT cluster, label, count(*) AS n FROM h WHERE label IS NOT NULL GROUP BY ALL),
g AS (SELECT cluster, label AS major FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS r FROM k) WHERE r = 1) SELECT row_id, coalesce(label, major) AS label FROM h LEFT JOIN g USING (cluster)""")  # fmt: skip
def repaired_labels(spark, sf_dir):
    """K4: two in three labels are missing and come from the cluster."""
    a = c.assign_modes(_rows(spark, sf_dir), _START).withColumn("label", F.when(F.col("row_id") % 3 == 0, F.col("label")))
    return c.repair_labels(a).select("row_id", F.col("repaired").alias("label"))


_SEEDS = "SELECT label AS k, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS o FROM x) WHERE o = 1 GROUP BY label"


@register("seeded_modes", _rounds_sql(_SEEDS) + """, g AS (SELECT k, label AS major FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, label) AS o FROM (SELECT k, label, count(*) AS n FROM fin GROUP BY ALL)) WHERE o = 1)
SELECT fin.k AS cluster, coalesce(label, major) AS repaired, count(*) AS n FROM fin LEFT JOIN g USING (k) GROUP BY ALL""")
def seeded_modes(spark, sf_dir):
    """K4: k-modes from the first labelled row of each class."""
    rows = _rows(spark, sf_dir)
    return c.repair_labels(c.k_modes(rows, c.seeds(rows))[0]).groupBy("cluster", "repaired").agg(F.count("*").alias("n"))


_HALF = "SELECT row_id, a, b, c, CASE WHEN row_id % 3 = 0 THEN label END AS label FROM x"
_DRAWN = f"""SELECT label AS k, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS o FROM ({_HALF}) WHERE label IS NOT NULL) WHERE o = 1 GROUP BY label
UNION ALL SELECT 1 + row_number() OVER (ORDER BY {draw('row_id')}, row_id) AS k, a, b, c FROM ({_HALF}) WHERE label IS NULL QUALIFY k < 4"""


@register("seeded_modes_drawn", _rounds_sql(_DRAWN) + """, h AS (SELECT k, CASE WHEN row_id % 3 = 0 THEN label END AS label FROM fin),
g AS (SELECT k, label AS major FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, label) AS o FROM (SELECT k, label, count(*) AS n FROM h WHERE label IS NOT NULL GROUP BY ALL)) WHERE o = 1)
SELECT h.k AS cluster, coalesce(label, major) AS repaired, count(*) AS n FROM h LEFT JOIN g USING (k) GROUP BY ALL""")
def seeded_modes_drawn(spark, sf_dir):
    """K4 with more clusters than classes: those without a labelled row start from drawn unlabelled ones."""
    rows = _rows(spark, sf_dir).withColumn("label", F.when(F.col("row_id") % 3 == 0, F.col("label")))
    return c.repair_labels(c.k_modes(rows, c.seeds_drawn(rows, 4))[0]).groupBy("cluster", "repaired").agg(F.count("*").alias("n"))


@register("cluster_tightness", _ASSIGN + " SELECT round(avg(t), 6) AS r FROM (SELECT avg(1 - mismatches / 3.0) AS t FROM s GROUP BY cluster)")
def cluster_tightness(spark, sf_dir):
    """How close rows are to their centres."""
    return c.tightness(c.assign_modes(_rows(spark, sf_dir), _START), 3).select(F.round("r", 6).alias("r"))


def _two(spark, sf_dir):
    rows = c.assign_modes(_rows(spark, sf_dir), _START)
    return c.modes(rows.where("row_id % 2 = 0")), c.modes(rows.where("row_id % 2 = 1"))


def _drift_sql(weighted: bool) -> str:
    half = lambda k: f"(SELECT cluster, feature, value AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster, feature ORDER BY n DESC, value) AS r FROM (SELECT cluster, feature, value, count(*) AS n FROM cell2 WHERE row_id % 2 = {k} GROUP BY ALL)) WHERE r = 1)"
    mean = "sum(s * w) / sum(w)" if weighted else "avg(s)"
    return _ASSIGN + f""", cell2 AS (SELECT row_id, cluster, 0 AS feature, a AS value FROM s UNION ALL SELECT row_id, cluster, 1, b FROM s UNION ALL SELECT row_id, cluster, 2, c FROM s),
b AS (SELECT n.cluster, o.cluster AS oc, avg(CAST(n.mode = o.mode AS INT)) AS s, sum(n.n + o.n) AS w FROM {half(1)} n JOIN {half(0)} o USING (feature) GROUP BY ALL),
t AS (SELECT s, w FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, w DESC) AS r FROM b) WHERE r = 1) SELECT round(1 - {mean}, 6) AS distance FROM t"""


@register("drift_distance", _drift_sql(False))
def drift_distance(spark, sf_dir):
    """R2: how far the clusters of one half of the stream are from the other's."""
    return c.cluster_set_distance(*_two(spark, sf_dir)).select(F.round("distance", 6).alias("distance"))


@register("drift_test", _drift_sql(False).rsplit(" SELECT round(", 1)[0] + """, h AS (SELECT row_id % 2 AS half, cluster, avg(1 - mismatches / 3.0) AS t FROM s GROUP BY ALL),
r AS (SELECT half, avg(t) AS r FROM h GROUP BY half), z AS (SELECT 1 - avg(s) AS distance FROM t) SELECT round(distance, 6) AS distance, distance >= (SELECT sum(r) FROM r) AS drifted FROM z""")  # fmt: skip
def drift_test(spark, sf_dir):
    """Whether the halves' clusters are farther apart than both are loose."""
    rows = c.assign_modes(_rows(spark, sf_dir), _START)
    tight = [c.tightness(rows.where(F.col("row_id") % 2 == k), 3).first()[0] or 0.0 for k in (0, 1)]
    far = c.cluster_set_distance(*_two(spark, sf_dir))
    return far.select(F.round("distance", 6).alias("distance"), (F.col("distance") >= sum(tight)).alias("drifted"))


@register("drift_distance_mixed", f"""{_ASSIGN}, v AS (SELECT s.row_id % 2 AS half, cluster, a, b, f0 FROM s JOIN m USING (row_id)),
mo AS (SELECT half, cluster, f, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY half, cluster, f ORDER BY n DESC, v) AS o FROM
  (SELECT half, cluster, f, v, count(*) AS n FROM (SELECT half, cluster, 'a' AS f, a AS v FROM v UNION ALL SELECT half, cluster, 'b', b FROM v) GROUP BY ALL)) WHERE o = 1),
e AS (SELECT half, cluster, min(f0) AS lo, max(f0) AS hi, count(*) AS k FROM v GROUP BY ALL),
p AS (SELECT n.cluster, o.cluster AS oc, ((SELECT count(*) FROM v WHERE half = 1 AND v.cluster = n.cluster AND f0 BETWEEN o.lo AND o.hi) + (SELECT count(*) FROM v WHERE half = 0 AND v.cluster = o.cluster AND f0 BETWEEN n.lo AND n.hi)) / (n.k + o.k) AS s
  FROM e n, e o WHERE n.half = 1 AND o.half = 0),
q AS (SELECT cluster, oc, s FROM p UNION ALL SELECT n.cluster, o.cluster, CAST(n.mode = o.mode AS DOUBLE) FROM mo n JOIN mo o ON n.f = o.f WHERE n.half = 1 AND o.half = 0)
SELECT round(1 - avg(s), 6) AS distance FROM (SELECT cluster, max(s) AS s FROM (SELECT cluster, oc, avg(s) AS s FROM q GROUP BY ALL) GROUP BY cluster)""")  # fmt: skip
def drift_distance_mixed(spark, sf_dir):
    """R2 over categories and numbers: two of the former by modes, one of the latter by how much the clusters' values overlap."""
    rows = c.assign_modes(_rows(spark, sf_dir), _START).withColumn("x", F.slice("x", 1, 2)).join(matrix(spark, sf_dir).select("row_id", "f0"), "row_id")
    half = lambda k: rows.where(F.col("row_id") % 2 == k)
    cells = tuple(half(k).select("cluster", F.lit(9).alias("feature"), F.col("f0").alias("value")) for k in (0, 1))
    return c.mixed_distance(c.modes(half(0)), c.modes(half(1)), cells).select(F.round("distance", 6).alias("distance"))


@register("labels_by_match", f"""WITH {_X}, k AS (SELECT a, b, c, min(label) AS matched FROM x WHERE row_id % 3 = 0 GROUP BY ALL) SELECT row_id, matched FROM x LEFT JOIN k USING (a, b, c)""")
def labels_by_match(spark, sf_dir):
    """K3: labels of rows from a third of them, by equal features."""
    rows = _rows(spark, sf_dir)
    return c.labels_by_match(rows.drop("label"), rows.where("row_id % 3 = 0")).select("row_id", "matched")


@register("drift_distance_weighted", _drift_sql(True))
def drift_distance_weighted(spark, sf_dir):
    """The same, by the clusters' sizes."""
    return c.cluster_set_distance(*_two(spark, sf_dir), weighted=True).select(F.round("distance", 6).alias("distance"))


@register("interval_similarity", f"""WITH {MATRIX}, a AS (SELECT min(f0) AS lo, max(f0) AS hi FROM m WHERE label = 1), b AS (SELECT min(f0) AS lo, max(f0) AS hi FROM m WHERE label = 0)
SELECT 0 AS feature, round(avg(CASE WHEN label = 1 THEN CAST(f0 BETWEEN b.lo AND b.hi AS INT) ELSE CAST(f0 BETWEEN a.lo AND a.hi AS INT) END), 6) AS similarity FROM m, a, b""")  # fmt: skip
def interval_similarity(spark, sf_dir):
    """How much two classes' values overlap."""
    m = matrix(spark, sf_dir)
    of = lambda k: m.where(F.col("label") == k).select(F.lit(0).alias("feature"), F.col("f0").alias("value"))
    return c.interval_similarity(of(1), of(0)).select("feature", F.round("similarity", 6).alias("similarity"))
