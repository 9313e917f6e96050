"""Decision trees on streams: count tables, split search, Hoeffding decisions, routing, growth by micro-batch.

All statistics are counts by (node, feature, value, class): partially aggregated, additive over
micro-batches, and as small as the values are few. A level of the tree is one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators import clusters, order
from driftloom.operators.lineage import cut

DELTA, TIE, LEAST_ROWS = 0.001, 0.5, 20
#: Rows that a leaf must have seen before it is asked whether it drifted with its sibling.
SIBLING_ROWS = 120


def class_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(…keys, feature_id, value, n0, n1) from cells (…keys, feature_id, value, label)."""
    return cells.where("label is not null and value is not null").groupBy(*keys, "feature_id", "value").agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )


def _gini(a: Column, b: Column) -> Column:
    n = a + b
    return F.when(n > 0, 1 - F.pow(a / n, 2) - F.pow(b / n, 2)).otherwise(0.0)


def numeric_splits(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(…keys, feature_id, cut, g, root, n): weighted Gini of each midpoint between neighbouring values, by running sums over ranges of the values."""
    s = order.running(counts, [*keys, "feature_id"], "value", ["n0", "n1"])
    l0, l1, t0, t1 = (F.col(c) for c in ("upto_n0", "upto_n1", "total_n0", "total_n1"))
    l, t = l0 + l1, t0 + t1
    g = _gini(l0, l1) * l / t + _gini(t0 - l0, t1 - l1) * (t - l) / t
    return s.where("next is not null").select(*keys, "feature_id", ((F.col("value") + F.col("next")) / 2).alias("cut"), g.alias("g"), _gini(t0, t1).alias("root"), t.alias("n"))


def one_against_rest(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(…keys, feature_id, value, g): weighted Gini of each single category against all others."""
    per = Window.partitionBy(*keys, "feature_id")
    s = counts.withColumn("t0", F.sum("n0").over(per)).withColumn("t1", F.sum("n1").over(per))
    n, t = F.col("n0") + F.col("n1"), F.col("t0") + F.col("t1")
    g = _gini(F.col("n0"), F.col("n1")) * n / t + _gini(F.col("t0") - F.col("n0"), F.col("t1") - F.col("n1")) * (t - n) / t
    return s.select(*keys, "feature_id", "value", g.alias("g"))


def subset_splits(counts: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """(…keys, feature_id, members, g): every subset of at most ``most`` categories, up to its complement, as a bit mask."""
    cats = counts.groupBy(*keys, "feature_id").agg(F.array_sort(F.collect_list(F.struct("value", "n0", "n1"))).alias("c")).where(F.size("c").between(2, most))
    masks = cats.select("*", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size("c") - 1) - 1).cast("int"))).alias("mask"))
    inside = lambda i: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2.0), i)), F.lit(2)) == 1
    masks = masks.withColumn("in", F.filter("c", lambda x, i: inside(i)))
    total = lambda c, n: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x[n])
    m = masks.select(*keys, "feature_id", F.transform("in", lambda x: x["value"]).alias("members"), total("in", "n0").alias("a0"), total("in", "n1").alias("a1"), total("c", "n0").alias("t0"), total("c", "n1").alias("t1"))
    a, t = F.col("a0") + F.col("a1"), F.col("t0") + F.col("t1")
    g = _gini(F.col("a0"), F.col("a1")) * a / t + _gini(F.col("t0") - F.col("a0"), F.col("t1") - F.col("a1")) * (t - a) / t
    return m.select(*keys, "feature_id", "members", g.alias("g"))


def best_splits(splits: DataFrame, keys: list[str]) -> DataFrame:
    """(…keys, feature_id, cut, g, second, root, n): the best cut, first among equals, and the best of another feature."""
    by_feature = splits.groupBy(*keys, "feature_id").agg(F.min(F.struct("g", "cut")).alias("b"), F.first("root").alias("root"), F.first("n").alias("n"))
    top = F.array_sort(F.collect_list(F.struct(F.col("b.g").alias("g"), "feature_id", F.col("b.cut").alias("cut"), "root", "n")))
    best = by_feature.groupBy(*keys).agg(top.alias("t"))
    one, two = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return best.select(*keys, one["feature_id"].alias("feature_id"), one["cut"].alias("cut"), one["g"].alias("g"), two["g"].alias("second"), one["root"].alias("root"), one["n"].alias("n"))


def accepts(delta: float = DELTA, tie: float = TIE, least: int = LEAST_ROWS) -> Column:
    """Whether a row of :func:`best_splits` is certain enough: the Hoeffding bound of two classes, or a tie."""
    eps = F.sqrt(F.log(F.lit(1 / delta)) / (2 * F.col("n")))
    gap = F.coalesce("second", "root") - F.col("g")
    return (F.col("n") >= least) & (F.col("g") < F.col("root")) & ((gap > eps) | ((gap < eps) & (eps < tie)))


def categorical_splits(counts: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """(…keys, feature_id, members, g, root, n): all subsets where a feature has at most ``most`` values, each value against the rest where it has more."""
    per = counts.groupBy(*keys, "feature_id").agg(F.count("*").alias("k"), F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    few = subset_splits(counts, keys, most)
    many = one_against_rest(counts.join(per.where(F.col("k") > most).select(*keys, "feature_id"), [*keys, "feature_id"], "left_semi"), keys)
    both = few.unionByName(many.select(*keys, "feature_id", F.array("value").alias("members"), "g"))
    root = per.select(*keys, "feature_id", _gini(F.col("t0"), F.col("t1")).alias("root"), (F.col("t0") + F.col("t1")).alias("n"))
    return both.join(root, [*keys, "feature_id"])


@dataclass
class Node:
    """A test (value <= cut, or value among members, goes left) or a leaf; a missing value goes left."""

    feature: int | None = None
    cut: float | None = None
    left: Node | None = None
    right: Node | None = None
    label: int = 0
    members: tuple | None = None

    def split(self, feature: int, cut: float | None, members=None) -> None:
        self.feature, self.cut, self.members = feature, cut, tuple(members) if members is not None else None
        self.left, self.right = Node(label=self.label), Node(label=self.label)

    def clear(self) -> None:
        self.feature = self.cut = self.left = self.right = self.members = None


def grow(rows: DataFrame, features: list[str], label: str = "label", depth: int = 3) -> Node:
    """A tree of at most 2 ** depth leaves: one aggregation for each level; the driver sees a row for each node."""
    root = Node(label=(rows.where(f"{label} is not null").groupBy(label).count().orderBy(F.desc("count"), label).first() or [0])[0])
    cells = F.inline(F.array(*(F.struct(F.lit(i).alias("feature_id"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features))))
    leaves = {1: root}
    for _ in range(depth):
        if not leaves:
            break
        at = rows.select(node_id(root, features).alias("node"), F.col(label).alias("label"), *features).where(F.col("node").isin(*leaves))
        counts = class_counts(at.select("node", "label", cells), ["node"])
        new = {}
        for r in best_splits(numeric_splits(counts, ["node"]), ["node"]).where(accepts()).collect():
            node = leaves[r.node]
            node.split(r.feature_id, r.cut)
            new[2 * r.node], new[2 * r.node + 1] = node.left, node.right
        majority = rows.select(node_id(root, features).alias("node"), F.col(label).alias("label")).where("label is not null").groupBy("node").agg(F.count_if(F.col("label") == 1).alias("a"), F.count("*").alias("n"))
        for r in majority.collect():
            if r.node in new:
                new[r.node].label = int(2 * r.a > r.n)
        leaves = new
    return root


def name_leaves(tree: Node, rows: DataFrame, features: list[str], label: str) -> None:
    """Each leaf's label: what most of its rows with a known label are; one without such rows keeps what it has."""
    at = rows.select(node_id(tree, features).alias("node"), F.col(label).alias("label")).where("label is not null")
    leaves = dict(_leaves(tree))
    for r in at.groupBy("node").agg(F.count_if(F.col("label") == 1).alias("a"), F.count("*").alias("n")).collect():
        leaves[r.node].label = int(2 * r.a > r.n)


def _walk(node: Node, features: list[str], number: int, leaf) -> Column:
    if node.feature is None:
        return F.lit(leaf(node, number))
    value = F.col(features[node.feature])
    left = F.coalesce(value.isin(*node.members) if node.members is not None else value <= node.cut, F.lit(True))
    return F.when(left, _walk(node.left, features, 2 * number, leaf)).otherwise(_walk(node.right, features, 2 * number + 1, leaf))


def node_id(tree: Node, features: list[str]) -> Column:
    """Where a row ends, by heap number; a missing value goes left."""
    return _walk(tree, features, 1, lambda _, k: k)


def predict(tree: Node, features: list[str]) -> Column:
    return _walk(tree, features, 1, lambda n, _: n.label)


def describe(tree: Node, number: int = 1) -> list[tuple]:
    """(node, feature, cut or members, label) from the root."""
    if tree.feature is None:
        return [(number, None, None, tree.label)]
    return [(number, tree.feature, tree.cut if tree.members is None else list(tree.members), tree.label), *describe(tree.left, 2 * number), *describe(tree.right, 2 * number + 1)]


def either(a: Column, b: Column) -> Column:
    """The two-space ensemble of 0/1 labels: 1 if either is."""
    return F.greatest(a, b)


def reset_drifted(tree: Node, numbers: set[int], number: int = 1) -> set[int]:
    """Nodes whose clusters drifted become leaves again and learn anew; the numbers of all nodes that this took away."""
    if number in numbers:
        gone = {k for k, *_ in describe(tree, number)}
        tree.clear()
        return gone
    if tree.feature is None:
        return set()
    return reset_drifted(tree.left, numbers, 2 * number) | reset_drifted(tree.right, numbers, 2 * number + 1)


class StreamTree:
    """A tree that grows by micro-batch, with repaired labels, cluster history and drift at its leaves.

    Rows wait at their leaf until it has ``least`` of them. A ready leaf's rows are clustered by
    k-modes from the first labelled row of each class, missing labels become their cluster's main
    one, and the counts of (leaf, feature, value, class) grow. A leaf whose best split is certain
    is split. One that is not compares its clusters with those it had: at a distance of both
    tightnesses or more the leaf has drifted. Then its sibling decides: if that is a leaf with
    clusters of its own that has seen ``sibling_rows`` rows, and the last of these have drifted
    from its clusters too, their parent becomes a leaf again and learns anew; else all stays, and
    the drifted leaf keeps its old clusters. Without a drift, or at the root, the new clusters
    replace the old.

    Waiting and recent rows, counts and clusters are tables keyed by node and cut after each batch.
    The driver holds the tree and sees a row for each ready leaf, and for each of its clusters and
    features. Counts hold each distinct number that a leaf saw; with ``digits``, numbers are counted by
    so many leading binary digits, so that counts stay small however long the stream, and cuts are
    that exact. :meth:`save` writes all of it, so that another process can :meth:`load` it and go on.
    """

    _TABLES = ("waiting", "recent", "counts", "history")

    def __init__(self, row_id: str, numeric: list[str], categories: list[str], label: str, width: float = 10.0, delta: float = DELTA, tie: float = TIE, least: int = LEAST_ROWS, sibling_rows: int = SIBLING_ROWS, digits: int | None = None):
        self.row_id, self.numeric, self.categories, self.label, self.width = row_id, numeric, categories, label, width
        self.features, self.delta, self.tie, self.least, self.sibling_rows = [*numeric, *categories], delta, tie, least, sibling_rows
        self.digits = digits
        self.root, self.log = Node(), []
        self.waiting: DataFrame | None = None
        self.recent: DataFrame | None = None
        self.counts: DataFrame | None = None
        self.history: DataFrame | None = None
        self.tight: dict[int, float] = {}

    def _modal(self, rows: DataFrame) -> DataFrame:
        """Features as categories, numbers by ranges of ``width``."""
        cell = lambda f: F.coalesce((F.floor(F.col(f) / self.width) if f in self.numeric else F.col(f)).cast("string"), F.lit(""))
        return rows.withColumn("x", F.array(*map(cell, self.features)))

    def _clustered(self, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with their cluster and repaired label, and the clusters (node, cluster, feature, mode, n), after one round of new modes."""
        seeds = ready.where(F.col(self.label).isNotNull()).groupBy("node", F.col(self.label).alias("cluster")).agg(F.min(F.struct(self.row_id, "x")).alias("s"))
        first = ready.groupBy("node").agg(F.min(F.struct(self.row_id, "x")).alias("s")).withColumn("cluster", F.lit(0))
        seeds = seeds.select("node", "cluster", "s").unionByName(first.join(seeds, "node", "left_anti").select("node", "cluster", "s"))
        centres = seeds.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("s.x").alias("x")))).alias("centres"))
        for turn in range(2):
            away = lambda c: F.aggregate(F.zip_with("x", c["x"], lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, b: a + b)
            best = F.array_min(F.transform("centres", lambda c: F.struct(away(c).alias("mismatches"), c["cluster"].alias("cluster"))))
            near = ready.join(F.broadcast(centres), "node").withColumn("_b", best)
            near = near.withColumns({"cluster": F.col("_b.cluster"), "mismatches": F.col("_b.mismatches")}).drop("_b", "centres")
            cells = near.select("node", "cluster", F.posexplode("x").alias("feature", "value")).groupBy("node", "cluster", "feature", "value").agg(F.count("*").alias("n"))
            modes = cells.groupBy("node", "cluster", "feature").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
            modes = cut(modes.select("node", "cluster", "feature", F.col("b.value").alias("mode"), (-F.col("b.m")).alias("n")))
            if not turn:
                per = modes.groupBy("node", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "mode"))), lambda f: f["mode"]).alias("x"))
                centres = per.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("cluster", "x"))).alias("centres"))
        major = near.where(F.col(self.label).isNotNull()).groupBy("node", "cluster", self.label).agg(F.count("*").alias("n"))
        major = major.groupBy("node", "cluster").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(self.label).alias("l"))).alias("b"))
        major = major.select("node", "cluster", F.col("b.l").alias("_major"))
        rows = near.join(F.broadcast(major), ["node", "cluster"], "left")
        return cut(rows.withColumn("told", F.coalesce(self.label, "_major")).drop("_major")), modes

    def step(self, batch: DataFrame) -> DataFrame:
        """``batch`` with node and predicted, as the tree sees it before it learns from it; then :meth:`update`."""
        said = cut(self.predict(batch))
        self.update(batch)
        return said

    def update(self, batch: DataFrame) -> None:
        """One micro-batch: rows with the features, the label (null where unknown) and the row id, which are kept in its order."""
        new = cut(batch.select(self.row_id, *self.features, self.label))
        self._remember(new)
        rows = new if self.waiting is None else self.waiting.select(new.columns).unionByName(new)
        rows = cut(self._modal(rows.withColumn("node", node_id(self.root, self.features).cast("long"))))
        full = [r.node for r in rows.groupBy("node").count().where(F.col("count") >= self.least).collect()]
        is_full = F.col("node").isin(full) if full else F.lit(False)
        self.waiting = cut(rows.where(~is_full).select(self.row_id, *self.features, self.label))
        if not full:
            return
        near, modes = self._clustered(rows.where(is_full))
        names = {f: i for i, f in enumerate(self.features)}
        cells = F.inline(F.array(*(F.struct(F.lit(i).alias("feature_id"), self._counted(f).cast("string").alias("value")) for f, i in names.items())))
        new = class_counts(near.select("node", F.col("told").alias("label"), cells), ["node"])
        if self.counts is not None:
            new = self.counts.unionByName(new).groupBy("node", "feature_id", "value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        self.counts = cut(new)
        split = self._split(full)
        self._compare([k for k in full if k not in split], near, modes)
        self._name_leaves()
        at = [k for k, _ in _leaves(self.root)]
        self.recent = self.recent.where(F.col("node").isin(at))

    def _counted(self, f: str) -> Column:
        if self.digits is None or f not in self.numeric:
            return F.col(f)
        v = F.col(f).cast("double")
        unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v))) - (self.digits - 1))
        return F.when(v == 0, v).otherwise(F.rint(v / unit) * unit)

    def _remember(self, new: DataFrame) -> None:
        """Each leaf's last ``sibling_rows`` rows."""
        new = new.withColumn("node", node_id(self.root, self.features).cast("long"))
        both = new if self.recent is None else self.recent.unionByName(new)
        last = Window.partitionBy("node").orderBy(F.desc(self.row_id))
        self.recent = cut(both.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= self.sibling_rows).drop("_k"))

    def _split(self, full: list[int]) -> set[int]:
        at = self.counts.where(F.col("node").isin(full))
        is_number = F.col("feature_id") < len(self.numeric)
        no = F.lit(None)
        cuts = numeric_splits(at.where(is_number).withColumn("value", F.col("value").cast("double")), ["node"])
        cuts = cuts.select("node", "feature_id", "cut", no.cast("array<string>").alias("members"), "g", "root", "n")
        sets = categorical_splits(at.where(~is_number), ["node"])
        sets = sets.select("node", "feature_id", no.cast("double").alias("cut"), "members", "g", "root", "n")
        both = cuts.unionByName(sets)
        both = both.select("node", "feature_id", F.struct("cut", "members").alias("cut"), "g", "root", "n")
        done = set()
        leaves = dict(_leaves(self.root))
        for r in best_splits(both, ["node"]).where(accepts(self.delta, self.tie, self.least)).collect():
            leaves[r.node].split(r.feature_id, r.cut.cut, r.cut.members)
            self.log.append(("split", r.node))
            done.add(r.node)
        return done

    def _tightness(self, near: DataFrame) -> dict[int, float]:
        share = near.groupBy("node", "cluster").agg(F.avg(1 - F.col("mismatches") / len(self.features)).alias("s"))
        return {r.node: r.r for r in share.groupBy("node").agg(F.avg("s").alias("r")).collect()}

    def _away(self, nodes: list[int], modes: DataFrame, tight: dict[int, float]) -> set[int]:
        """Those of ``nodes`` whose clusters drifted from the ones they had."""
        if self.history is None or not nodes:
            return set()
        found = clusters.cluster_set_distances(self.history, modes.where(F.col("node").isin(nodes)), ["node"]).collect()
        return {r.node for r in found if clusters.drifted(r.distance, self.tight[r.node], tight[r.node])}

    def _compare(self, nodes: list[int], near: DataFrame, modes: DataFrame) -> None:
        """The clusters of leaves that were not split, against those they had."""
        tight = self._tightness(near)
        away = self._away(nodes, modes, tight)
        self.log += [("drift", k) for k in sorted(away)]
        back = self._with_siblings({k for k in away if k > 1})
        fresh = [k for k in nodes if k not in away or k == 1]
        kept = modes.where(F.col("node").isin(fresh)) if fresh else modes.limit(0)
        if self.history is not None:
            kept = kept.unionByName(self.history.where(~F.col("node").isin([*fresh, 0])))
        gone = reset_drifted(self.root, back) | back if back else set()
        if gone:
            kept, self.counts = kept.where(~F.col("node").isin(list(gone))), cut(self.counts.where(~F.col("node").isin(list(gone))))
            self.log += [("back", k) for k in sorted(back)]
        self.history = cut(kept)
        self.tight = {k: v for k, v in {**self.tight, **{k: tight[k] for k in fresh}}.items() if k not in gone}

    def _with_siblings(self, away: set[int]) -> set[int]:
        """Parents of the drifted leaves whose siblings drifted too."""
        leaves = {k for k, _ in _leaves(self.root)}
        asked = sorted({k ^ 1 for k in away} & leaves & set(self.tight))
        if not asked:
            return set()
        rows = self.recent.where(F.col("node").isin(asked))
        asked = [r.node for r in rows.groupBy("node").count().where(F.col("count") >= self.sibling_rows).collect()]
        if not asked:
            return set()
        near, modes = self._clustered(self._modal(rows.where(F.col("node").isin(asked))))
        return {k // 2 for k in self._away(asked, modes, self._tightness(near))}

    def _name_leaves(self) -> None:
        """A leaf's label is its main class; one without counts keeps its parent's."""
        first = self.counts.where("feature_id = 0").groupBy("node").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
        leaves = dict(_leaves(self.root))
        main = {r.node: int(r.b > r.a) for r in first.collect()}
        for number, leaf in leaves.items():
            while number and number not in main:
                number //= 2
            leaf.label = main.get(number, leaf.label)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with node and predicted."""
        return rows.withColumns({"node": node_id(self.root, self.features), "predicted": predict(self.root, self.features)})


    def save(self, path: str) -> None:
        """The tree and its tables, under ``path``; what is there is written over."""
        held = [t for t in self._TABLES if getattr(self, t) is not None]
        for t in held:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")
        nodes = [(k, f, c if isinstance(c, float) else None, c if isinstance(c, list) else None, n, self.tight.get(k)) for k, f, c, n in _all_nodes(self.root)]
        spark = self._spark()
        spark.createDataFrame(nodes, "node long, feature int, cut double, members array<string>, label int, tight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        log = [(i, kind, k) for i, (kind, k) in enumerate(self.log)]
        spark.createDataFrame([(held, log)], "held array<string>, log array<struct<i:long,kind:string,node:long>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    def load(self, spark, path: str) -> StreamTree:
        """What :meth:`save` wrote, into this tree; its parameters stay."""
        about = spark.read.parquet(f"{path}/about").first()
        for t in self._TABLES:
            setattr(self, t, spark.read.parquet(f"{path}/{t}") if t in about.held else None)
        self.log = [(e.kind, e.node) for e in about.log]
        nodes = {r.node: r for r in spark.read.parquet(f"{path}/nodes").collect()}
        self.tight = {k: r.tight for k, r in nodes.items() if r.tight is not None}

        def made(k: int) -> Node:
            r = nodes[k]
            if r.feature is None:
                return Node(label=r.label)
            return Node(r.feature, r.cut, made(2 * k), made(2 * k + 1), r.label, tuple(r.members) if r.members is not None else None)

        self.root = made(1)
        return self

    def _spark(self):
        return (self.waiting if self.waiting is not None else self.counts).sparkSession


class TwoSpaces:
    """Two stream trees over the observed and the latent space of one stream, which step through the same batches.

    Each batch is predicted by both before either learns from it; a row's label is 1 if either
    says so. Both trees have the same row id and label columns.
    """

    def __init__(self, x: StreamTree, z: StreamTree):
        self.x, self.z = x, z

    def step(self, batch: DataFrame) -> DataFrame:
        """``batch`` with predicted_x, predicted_z and predicted."""
        x, z = predict(self.x.root, self.x.features), predict(self.z.root, self.z.features)
        said = cut(batch.withColumns({"predicted_x": x, "predicted_z": z, "predicted": either(x, z)}))
        self.x.update(batch)
        self.z.update(batch)
        return said

    def save(self, path: str) -> None:
        self.x.save(f"{path}/x")
        self.z.save(f"{path}/z")

    def load(self, spark, path: str) -> TwoSpaces:
        self.x.load(spark, f"{path}/x")
        self.z.load(spark, f"{path}/z")
        return self


def _all_nodes(tree: Node, number: int = 1) -> list[tuple]:
    """(node, feature, cut or members, label) of all nodes, inner ones with their own label."""
    if tree.feature is None:
        return [(number, None, None, tree.label)]
    test = float(tree.cut) if tree.members is None else list(map(str, tree.members))
    return [(number, tree.feature, test, tree.label), *_all_nodes(tree.left, 2 * number), *_all_nodes(tree.right, 2 * number + 1)]


def _leaves(tree: Node, number: int = 1) -> list[tuple[int, Node]]:
    if tree.feature is None:
        return [(number, tree)]
    return _leaves(tree.left, 2 * number) + _leaves(tree.right, 2 * number + 1)
