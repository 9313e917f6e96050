"""Density peaks over the embeddings."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from driftloom.operators import density as d
from driftloom.operators import trees
from driftloom.operators.lineage import cut
from driftloom.plans.registry import register
from driftloom.plans.tables import table

#: Distance within which points count as near: about two pairs in a hundred are nearer.
_DC = 1.2
# the vectors as columns: distances of lists are slow in SQL
_D = " + ".join(f"(a.x{i} - b.x{i}) ** 2" for i in range(1, 65))
_P = f"WITH p AS (SELECT vec_id AS id, {', '.join(f'embedding[{i}]::DOUBLE AS x{i}' for i in range(1, 65))} FROM embeddings), q AS (SELECT a.id AS i, b.id AS j, sqrt({_D}) AS d FROM p a JOIN p b ON a.id < b.id)"
_RHO = _P + f", r AS (SELECT id, sum(exp(-pow(d / {_DC}, 2))) AS rho FROM (SELECT i AS id, d FROM q UNION ALL SELECT j, d FROM q) GROUP BY id)"
_PEAK = _RHO + """, up AS (SELECT CASE WHEN a.rho > b.rho OR (a.rho = b.rho AND i < j) THEN j ELSE i END AS id, d, CASE WHEN a.rho > b.rho OR (a.rho = b.rho AND i < j) THEN i ELSE j END AS par FROM q JOIN r a ON a.id = i JOIN r b ON b.id = j),
low AS (SELECT id, d, par FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, par) AS n FROM up) WHERE n = 1),
k AS (SELECT r.id, rho, coalesce(low.d, (SELECT max(d) FROM q)) AS delta, par AS parent FROM r LEFT JOIN low USING (id)),
g AS (SELECT *, (rho - min(rho) OVER ()) / (max(rho) OVER () - min(rho) OVER ()) * (delta - min(delta) OVER ()) / (max(delta) OVER () - min(delta) OVER ()) AS gamma FROM k)"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def _peaks(spark, sf_dir):
    pts = _points(spark, sf_dir)
    rho = cut(d.densities(d.blocks(pts), _DC))
    return d.gammas(cut(d.peaks(pts.join(rho, "id"))))


@register("pair_distances", _P + " SELECT i, count(*) AS n, round(sum(d), 6) AS total FROM q GROUP BY i")
def pair_distances(spark, sf_dir):
    """All distances, summed by their smaller end."""
    return d.distance_sums(d.blocks(_points(spark, sf_dir))).withColumn("total", F.round("total", 6))


@register("distance_cutoff", _P + " SELECT round(d, 6) AS dc FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS n FROM q) WHERE n = (SELECT CAST(round_even(count(*) * 5 / 100.0, 0) AS BIGINT) FROM q)")
def distance_cutoff(spark, sf_dir):
    """The distance at five in a hundred."""
    dc = d.cutoff(d.blocks(_points(spark, sf_dir)), 5)
    return spark.range(1).select(F.round(F.lit(dc), 6).alias("dc"))


@register("distance_cutoff_counted", _P + """, m AS (SELECT d FROM q UNION ALL SELECT d FROM q UNION ALL SELECT 0 FROM p),
n AS (SELECT count(*) AS k FROM p) SELECT round(d, 6) AS dc FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r FROM m) WHERE r = (SELECT 2 * CAST(floor(k * (k - 1) / 2 * 2 / 100) AS BIGINT) + k - 1 FROM n)""")
def distance_cutoff_counted(spark, sf_dir):
    """D1, second form: the distance at two in a hundred of the square matrix."""
    pts = _points(spark, sf_dir)
    dc = d.cutoff_counted(d.blocks(pts), pts.count())
    return spark.range(1).select(F.round(F.lit(dc), 6).alias("dc"))


@register("bisected_cutoff", _P.replace("WITH p AS", "WITH RECURSIVE p AS") + """, e AS (SELECT min(d) AS lo, max(d) AS hi, count(*) AS n FROM q),
b AS (SELECT lo, hi, n, 0 AS step, NULL::DOUBLE AS found FROM e
  UNION ALL SELECT CASE WHEN share < 0.01 THEN mid ELSE lo END, CASE WHEN share > 0.02 THEN mid ELSE hi END, n, step + 1, CASE WHEN share BETWEEN 0.01 AND 0.02 THEN mid END
  FROM (SELECT *, (lo + hi) / 2 AS mid, (SELECT count(*) FROM q WHERE d < (lo + hi) / 2) / n AS share FROM b WHERE found IS NULL AND hi - lo > 1e-4))
SELECT round(coalesce(max(found), max_by((lo + hi) / 2, step)), 6) AS dc FROM b""")
def bisected_cutoff(spark, sf_dir):
    """A cutoff below which one to two pairs in a hundred lie, found by halving."""
    dc = d.cutoff_bisected(d.blocks(_points(spark, sf_dir)))
    return spark.range(1).select(F.round(F.lit(dc), 6).alias("dc"))


@register("densities", _RHO + " SELECT id, round(rho, 6) AS rho FROM r")
def densities(spark, sf_dir):
    """Gaussian densities."""
    return d.densities(d.blocks(_points(spark, sf_dir)), _DC).select("id", F.round("rho", 6).alias("rho"))


@register("cutoff_densities", _P + f" SELECT id, CAST(sum(CAST(d < {_DC} AS INT)) AS DOUBLE) AS rho FROM (SELECT i AS id, d FROM q UNION ALL SELECT j, d FROM q) GROUP BY id")
def cutoff_densities(spark, sf_dir):
    """D3: how many points are near."""
    return d.densities(d.blocks(_points(spark, sf_dir)), _DC, gaussian=False)


@register("density_peaks", _PEAK + " SELECT id, round(rho, 6) AS rho, round(delta, 6) AS delta, parent, round(gamma, 6) AS gamma FROM g")
def density_peaks(spark, sf_dir):
    """The nearest denser point of each, and what stands out."""
    return _peaks(spark, sf_dir).select("id", F.round("rho", 6).alias("rho"), F.round("delta", 6).alias("delta"), "parent", F.round("gamma", 6).alias("gamma"))


@register("peak_order", _PEAK + " SELECT id, round(gamma, 6) AS gamma, row_number() OVER (ORDER BY gamma DESC, id) AS rank FROM g ORDER BY gamma DESC, id LIMIT 30")
def peak_order(spark, sf_dir):
    """The thirty points that stand out most, a top-k report."""
    return d.ranked(_peaks(spark, sf_dir), 30).select("id", F.round("gamma", 6).alias("gamma"), F.col("rank").cast("long").alias("rank"))


@register("density_clusters", _PEAK.replace("WITH p AS", "WITH RECURSIVE p AS") + """, top AS (SELECT id FROM g ORDER BY gamma DESC, id LIMIT 8),
t AS (SELECT id, id AS cluster FROM g WHERE id IN (SELECT id FROM top) OR parent IS NULL UNION ALL SELECT g.id, t.cluster FROM g JOIN t ON g.parent = t.id WHERE g.id NOT IN (SELECT id FROM top) AND g.parent IS NOT NULL)
SELECT id, cluster FROM t""")  # fmt: skip
def density_clusters(spark, sf_dir):
    """Eight clusters, all points like their parents."""
    return d.assign(_peaks(spark, sf_dir), 8)


_COUNT = _PEAK + """, top AS (SELECT gamma AS x, row_number() OVER (ORDER BY gamma) - 1 AS i, count(*) OVER () AS n FROM (SELECT gamma FROM g ORDER BY gamma DESC, id LIMIT 30)),
ks AS (SELECT unnest(range(max(n) // 2, max(n) - 2)) AS k FROM top),
part AS (SELECT k, i >= k AS post, avg(x) AS mean, CASE WHEN min(x) = 0 THEN 1e-5 ELSE min(x) END AS s, count(*) AS c FROM top, ks GROUP BY ALL),
sums AS (SELECT part.k, post, sum(ln(CASE WHEN x = 0 THEN 1e-5 ELSE x END / s)) AS t FROM part JOIN top ON post = (i >= part.k) GROUP BY ALL),
law AS (SELECT k, post, mean, s, CASE WHEN t > 0 THEN c / t ELSE -ln(s) END AS a FROM part JOIN sums USING (k, post)),
fit AS (SELECT p.k, p.s AS s0, p.a AS a0, q.s AS s1, q.a AS a1 FROM law p JOIN law q USING (k) WHERE NOT p.post AND q.post AND p.mean <= 0.95 * q.mean AND least(p.a, q.a) > 0),
f AS (SELECT k, i, ln(a0) - ln(s0) - (1 + a0) * ln(1 + x / s0) AS f0, ln(a1) - ln(s1) - (1 + a1) * ln(1 + x / s1) AS f1 FROM fit JOIN top ON i >= k),
u AS (SELECT k, i, CASE WHEN greatest(max(f0) OVER w, 5e-324) > min(f0) OVER w THEN (f0 - min(f0) OVER w) / (greatest(max(f0) OVER w, 5e-324) - min(f0) OVER w) ELSE 0 END AS u0,
  CASE WHEN greatest(max(f1) OVER w, 5e-324) > min(f1) OVER w THEN (f1 - min(f1) OVER w) / (greatest(max(f1) OVER w, 5e-324) - min(f1) OVER w) ELSE 0 END AS u1 FROM f WINDOW w AS (PARTITION BY k)),
e AS (SELECT k, min(i) FILTER (WHERE u0 <= 0 OR u1 <= 0) AS z FROM u GROUP BY k),
b AS (SELECT k, sum(CASE WHEN z IS NULL OR i < z THEN ln(u0 / u1) ELSE 0 END) AS v FROM u JOIN e USING (k) GROUP BY k ORDER BY v DESC, k LIMIT 1)
SELECT CAST(coalesce((SELECT (SELECT max(n) FROM top) - 1 - k FROM b WHERE v > 0 AND v >= -ln(0.05) * 2 / (SELECT max(n) FROM top)), 1) AS INT) AS clusters"""


@register("peak_count", _COUNT)
def peak_count(spark, sf_dir):
    """How many of the thirty largest gammas stand out."""
    return spark.range(1).select(F.lit(d.cluster_count(d.gamma_list(_peaks(spark, sf_dir)))).alias("clusters"))


def _spread(spark, sf_dir, fit=None):
    labels = table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), "label")
    return d.spread_labels(_peaks(spark, sf_dir).join(_points(spark, sf_dir), "id"), labels, fit=fit)


@register("label_spreading")
def label_spreading(spark, sf_dir):
    """A tenth of the labels spread along the pointers of all points, to parents and then to children, by a batch tree fitted anew each hop."""
    return _spread(spark, sf_dir)


@register("label_spreading_linear")
def label_spreading_linear(spark, sf_dir):
    """The same with a linear learner."""
    return _spread(spark, sf_dir, lambda rows: LogisticRegression(featuresCol="v", labelCol="label", regParam=0.01, maxIter=10).fit(rows))


def _spread_by(spark, sf_dir, learner, label="label"):
    labels = table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), F.expr(label).alias("label"))
    return d.spread_labels(_peaks(spark, sf_dir).join(_points(spark, sf_dir), "id"), labels, learner=learner)


def _hops(name: str, start: str, here: str, there: str, k: int) -> str:
    """One direction of the spreading: each step hands on all labelled points, and adds those that it reaches."""
    return f"""{name} AS (SELECT id, label, hops, true AS fresh, step FROM {start}
  UNION ALL SELECT * FROM (WITH front AS (SELECT DISTINCT e.{there} AS id FROM {name} s JOIN k e ON e.{here} = s.id WHERE s.fresh AND e.parent IS NOT NULL AND e.{there} NOT IN (SELECT id FROM {name})),
    near AS (SELECT f.id, s.label, d, row_number() OVER (PARTITION BY f.id ORDER BY d, s.id) AS n FROM front f JOIN dist ON dist.i = f.id JOIN {name} s ON s.id = dist.j),
    w AS (SELECT id, label, CASE WHEN min(d) OVER (PARTITION BY id) = 0 THEN CAST(d = 0 AS INT)::DOUBLE ELSE 1 / d END AS w FROM near WHERE n <= {k}),
    told AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY sum(w) DESC, label) AS n FROM w GROUP BY id, label) WHERE n = 1)
    SELECT id, label, hops, false AS fresh, step + 1 AS step FROM {name} WHERE EXISTS (SELECT 1 FROM front)
    UNION ALL SELECT id, label, (SELECT max(step) + 1 FROM {name}), true, (SELECT max(step) + 1 FROM {name}) FROM told))"""


_KNN = _PEAK.replace("WITH p AS", "WITH RECURSIVE p AS") + f""", dist AS (SELECT i, j, d FROM q UNION ALL SELECT j, i, d FROM q),
seed AS (SELECT vec_id AS id, label, 0 AS hops, 0 AS step FROM embeddings WHERE vec_id % 10 = 0),
{_hops('onward', 'seed', 'id', 'parent', 5)},
turn AS (SELECT id, label, hops, step FROM onward WHERE step = (SELECT max(step) FROM onward)),
{_hops('backward', 'turn', 'parent', 'id', 5)}
SELECT id, label, hops FROM backward WHERE step = (SELECT max(step) FROM backward)"""


@register("label_spreading_nearest", _KNN)
def label_spreading_nearest(spark, sf_dir):
    """A tenth of the labels spread by the weighted vote of the five nearest labelled points."""
    return _spread_by(spark, sf_dir, d.NearestLearner(5))


@register("label_spreading_online")
def label_spreading_online(spark, sf_dir):
    """The parity of the labels spread by one online learner that goes on from hop to hop; from 0.3 on a point is odd."""
    return _spread_by(spark, sf_dir, d.OnlineLearner(0.3, unsure=0.05), "label % 2")


@register("label_spreading_tree")
def label_spreading_tree(spark, sf_dir):
    """The parity of the labels spread by an incremental tree whose counts grow by the fronts of the graph."""
    tree = trees.StreamTree("id", [f"x{i}" for i in range(64)], [], "label", width=0.2)
    return _spread_by(spark, sf_dir, d.TreeLearner(tree), "label % 2")


#: Batches in which the growing graph takes the points.
GROWING = 4


def growing_graph(spark, sf_dir) -> d.PointerGraph:
    """The points by the remainder of their id, a batch for each."""
    graph, pts = d.PointerGraph(_DC), cut(_points(spark, sf_dir))
    for j in range(GROWING):
        graph.add(pts.where(F.col("id") % GROWING == j))
    return graph


_COUNTED = _PEAK.replace(f"sum(exp(-pow(d / {_DC}, 2))) AS rho", f"sum(CAST(d < {_DC} AS INT))::DOUBLE AS rho")


@register("growing_peaks", _COUNTED + " SELECT id, rho, round(delta, 6) AS delta, parent FROM k")
def growing_peaks(spark, sf_dir):
    """D4 along a stream: densities and nearest denser points, repaired batch by batch where new points change them."""
    return growing_graph(spark, sf_dir).points.select("id", "rho", F.round("delta", 6).alias("delta"), "parent")


@register("label_spreading_growing")
def label_spreading_growing(spark, sf_dir):
    """D8 online: the parity of the labels spread by an online learner over the graph that grew batch by batch."""
    labels = table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("label"))
    return d.spread_labels(growing_graph(spark, sf_dir).points, labels, learner=d.OnlineLearner(0.3))
