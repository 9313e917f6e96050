"""Density peaks: distances, densities, nearest denser points, cluster counts and assignment.

All pairs are inherent to this method, which is meant for one micro-batch or a sample. Points are
packed in blocks; a task reads two of them, goes through their pairs tile by tile, each pair once,
and returns sums, counts or nearest points. So pairs are never rows, and nothing but the points
themselves and a few numbers a point and block is shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import numeric
from driftloom.operators import online, trees
from driftloom.operators.lineage import cut

#: Points of a block at most; fewer where that would give less than ``SPREAD`` blocks, but ``LEAST`` at least.
BLOCK_ROWS, SPREAD, LEAST = 16384, 8, 512
#: Rows and columns of the matrix of distances that is held at once.
TILE = 1024
#: Where a square is smaller than this part of the norms it comes from, it is taken by differences.
CLOSE = 1e-3
#: Part of the norms within which squares by products and by differences can differ, with room to spare.
SLACK = 1e-11


class Block:
    """Points that one task holds: their ids, their vectors and the other columns."""

    def __init__(self, packed: bytes):
        self.table = pa.ipc.open_stream(packed).read_all()
        self.ids = self["id"]

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, column: str) -> np.ndarray:
        return self.table[column].to_numpy()

    @cached_property
    def x(self) -> np.ndarray:
        return np.asarray(self.table["x"].combine_chunks().flatten(), float).reshape(len(self), -1)

    @cached_property
    def norms(self) -> np.ndarray:
        return (self.x * self.x).sum(1)


def blocks(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(k, t): ``points``, which have an id, a vector x and maybe more, in blocks of at most about ``block_rows``, stored."""
    n = points.count()
    parts = max(1, -(-n // block_rows), min(SPREAD, -(-n // LEAST)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some[0].schema) as out:
                for b in some:
                    out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["k", "t"])

    return cut(points.repartition(parts).mapInArrow(packed, "k int, t binary"))


def met(left: DataFrame, right: DataFrame | None, work: Callable[[Block, Block], pa.Table], schema: str) -> DataFrame:
    """``work(a, b)`` for every pair of :func:`blocks` of the two sides; without ``right``, for each pair of ``left`` once, where b is a for a block with itself.

    Each task reads the two partitions that it needs, so nothing is shuffled.
    """
    alone = right is None
    a = left.select(F.col("k").alias("_a"), F.col("t").alias("_left"))
    b = (left if alone else right).select(F.col("k").alias("_b"), F.col("t").alias("_right"))
    pairs = a.hint("shuffle_replicate_nl").join(b, F.col("_a") <= F.col("_b") if alone else F.lit(True))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, one, j, other in zip(*batch.columns, strict=True):
                first = Block(one.as_py())
                yield from work(first, first if alone and i.as_py() == j.as_py() else Block(other.as_py())).to_batches()

    return pairs.mapInArrow(each, schema)


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squares of the distances of rows ``i`` of x to rows ``j`` of y by differences: equal rows are exactly 0 apart."""
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 15):
        d = x[i[a : a + (1 << 15)]] - y[j[a : a + (1 << 15)]]
        out[a : a + (1 << 15)] = (d * d).sum(1)
    return out


def _slices(n: int) -> list[slice]:
    return [slice(a, min(a + TILE, n)) for a in range(0, n, TILE)]


def _squares(a: Block, b: Block, r: slice, c: slice) -> np.ndarray:
    """Squares of distances by products of vectors, small ones by differences."""
    x, y = a.x[r], b.x[c]
    norms = a.norms[r][:, None] + b.norms[c]
    d2 = x @ y.T
    d2 *= -2
    d2 += norms
    norms *= CLOSE
    i, j = np.nonzero(d2 < norms)
    if len(i):
        d2[i, j] = _exact(x, y, i, j)
    return d2


def tiles(a: Block, b: Block) -> Iterator[tuple[slice, slice, np.ndarray, bool]]:
    """(rows, columns, squared distances, whether some are infinite) over all pairs of two blocks, or once over those of one.

    A pair that is another's mirror image, and one of the same id, is infinitely far apart.
    """
    again = len(np.unique(a.ids)) < len(a) if a is b else bool(np.isin(a.ids, b.ids).any())
    for r in _slices(len(a)):
        for c in _slices(len(b)):
            if a is b and c.start < r.start:
                continue
            d2 = _squares(a, b, r, c)
            if a is b and c == r:
                d2[np.tri(len(d2), dtype=bool)] = np.inf
            if again:
                d2[a.ids[r][:, None] == b.ids[c]] = np.inf
            yield r, c, d2, again or (a is b and c == r)


def _near(a: Block, b: Block, r: slice, c: slice, d2: np.ndarray, dc: float) -> np.ndarray:
    """Which pairs of a tile are nearer than ``dc``; those about as far are looked at by differences."""
    near = d2 < dc * dc
    room = SLACK * (a.norms[r].max(initial=0) + b.norms[c].max(initial=0) + dc * dc)
    i, j = np.nonzero(np.abs(d2 - dc * dc) <= room)
    if len(i):
        near[i, j] = np.sqrt(_exact(a.x[r], b.x[c], i, j)) < dc
    return near


def _largest(d2: np.ndarray, some_infinite: bool) -> float:
    return float((d2[d2 < np.inf] if some_infinite else d2).max(initial=-1.0))


def _by_both(a: Block, b: Block, kinds: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Zeros for each point of both blocks, the same ones if they are one block."""
    left = [np.zeros(len(a)) for _ in range(kinds)]
    return left, left if a is b else [np.zeros(len(b)) for _ in range(kinds)]


def pair_distances(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, d) for i < j: all pairs as rows, for few points. The functions below go through pairs without making rows of them."""

    def work(a: Block, b: Block) -> pa.Table:
        out = [pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})]
        for r, c, d2, _ in tiles(a, b):
            at, to = np.nonzero(d2 < np.inf)
            i, j = a.ids[r][at], b.ids[c][to]
            out.append(pa.table({"i": np.minimum(i, j), "j": np.maximum(i, j), "d": np.sqrt(_exact(a.x[r], b.x[c], at, to))}))
        return pa.concat_tables(out)

    return met(blocks(points, block_rows), None, work, "i long, j long, d double")


def distance_sums(packed: DataFrame) -> DataFrame:
    """(i, n, total): of each point, how many have a larger id, and the sum of their distances; points without such are left out."""

    def work(a: Block, b: Block) -> pa.Table:
        left, right = _by_both(a, b, 2)
        for r, c, d2, holes in tiles(a, b):
            d = np.sqrt(d2)
            below = a.ids[r][:, None] < b.ids[c]
            above = ~below
            if holes:
                some = d2 < np.inf
                below &= some
                above &= some
                d[~some] = 0
            for to, at, mine, axis in ((left, r, below, 1), (right, c, above, 0)):
                to[0][at] += mine.sum(axis)
                to[1][at] += (d * mine).sum(axis)
        sides = [(a.ids, left)] if a is b else [(a.ids, left), (b.ids, right)]
        i, n, total = (np.concatenate(c) for c in zip(*((ids, *v) for ids, v in sides), strict=True))
        return pa.table({"i": i[n > 0], "n": n[n > 0].astype(np.int64), "total": total[n > 0]})

    return met(packed, None, work, "i long, n long, total double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def k_nearest(queries: DataFrame, points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, d, label, place): each query's ``k`` nearest points, ties by the point's id; both have id and x, points a label.

    Each pair of blocks gives at most ``k`` rows for a query, and these meet by query.
    """

    def work(a: Block, b: Block) -> pa.Table:
        labels, out = b["label"], []
        for r in _slices(len(a)):
            most, found = np.full(r.stop - r.start, np.inf), []
            for c in _slices(len(b)):
                d2 = _squares(a, b, r, c)
                if d2.shape[1] > k:
                    most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1])
                room = most + SLACK * (a.norms[r] + b.norms[c].max())
                i, j = np.nonzero(d2 <= room[:, None])
                found.append((i, j + c.start, np.sqrt(_exact(a.x[r], b.x[c], i, j))))
            i, j, d = (np.concatenate(f) for f in zip(*found, strict=True))
            by = np.lexsort((b.ids[j], d, i))
            i, j, d = i[by], j[by], d[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, d = (v[place < k] for v in (i, j, d))
            out.append(pa.table({"id": a.ids[r][i], "d": d, "other": b.ids[j], "label": labels[j]}))
        return pa.concat_tables(out)

    q = blocks(queries.select("id", "x"), block_rows)
    p = blocks(points.select("id", "x", F.col("label").cast("long").alias("label")), block_rows)
    near = met(q, p, work, "id long, d double, other long, label long")
    w = Window.partitionBy("id").orderBy("d", "other")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("other")


def vote(near: DataFrame) -> DataFrame:
    """(id, label) of :func:`k_nearest`: the label of most weight, the smallest among equals.

    A neighbour weighs the inverse of its distance; where some are at distance 0, only those count, alike.
    """
    some = F.min("d").over(Window.partitionBy("id")) == 0
    weight = F.when(some, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    sums = near.withColumn("w", weight).groupBy("id", "label").agg(F.sum("w").alias("w"))
    return sums.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select("id", F.col("b.label").alias("label"))


def span(packed: DataFrame) -> tuple[int, float, float]:
    """How many pairs there are, and their smallest and largest distance."""

    def work(a: Block, b: Block) -> pa.Table:
        n, low, high = 0, np.inf, -1.0
        for _, _, d2, holes in tiles(a, b):
            n += np.count_nonzero(d2 < np.inf) if holes else d2.size
            low, high = min(low, float(d2.min(initial=np.inf))), max(high, _largest(d2, holes))
        return pa.table({"n": [n], "low": [low], "high": [high]} if n else {c: pa.array([], t) for c, t in (("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()))})

    n, low, high = met(packed, None, work, "n long, low double, high double").agg(F.sum("n"), F.min("low"), F.max("high")).first()
    return (n, low**0.5, high**0.5) if n else (0, 0.0, 0.0)


def distance_at(packed: DataFrame, place: int, spanned: tuple[int, float, float] | None = None, buckets: int = 4096, few: int = 4096) -> float | None:
    """The distance at a place, from 0, of all pairs in order: counts by ranges narrow it down, pass by pass, so the driver sees counts and at most ``few`` values.

    Where more than that agree to twelve digits of the largest distance, they count as equal. ``spanned``: :func:`span`, if known.
    """
    n, low, top = spanned or span(packed)
    if not 0 <= place < n:
        return None
    high, levels = top, []
    bucket = lambda d, lo, hi: np.minimum((d - lo) * (buckets / (hi - lo)), buckets - 1).astype(np.int64)

    def inside(a: Block, b: Block) -> Iterator[np.ndarray]:
        """Distances that are in the range of every level, which is the last one's."""
        for _, _, d2, holes in tiles(a, b):
            if levels:
                pad = 1e-9 * top
                d = np.sqrt(d2[(d2 >= max(low - pad, 0.0) ** 2) & (d2 <= (high + pad) ** 2)])
            else:
                d = np.sqrt(d2[d2 < np.inf] if holes else d2.ravel())
            for lo, hi, at in levels:
                # what lies outside of a level's range is in none of its buckets
                d = d[(d >= lo) | (at == 0)]
                d = d[bucket(np.maximum(d, lo), lo, hi) == at]
            yield d

    while n > few and high - low > 1e-12 * top:

        def count(a: Block, b: Block) -> pa.Table:
            counts = np.zeros(buckets, np.int64)
            for d in inside(a, b):
                counts += np.bincount(bucket(np.maximum(d, low), low, high), minlength=buckets)
            return pa.table({"b": np.flatnonzero(counts), "n": counts[counts > 0]})

        for r in met(packed, None, count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).orderBy("b").collect():
            if place < r.n:
                break
            place -= r.n
        levels = [*levels, (low, high, r.b)]
        width = (high - low) / buckets
        n, low, high = r.n, low + r.b * width, low + (r.b + 1) * width
    if n > few:
        return low
    values = lambda a, b: pa.table({"v": np.concatenate([np.zeros(0), *inside(a, b)])})
    return sorted(r.v for r in met(packed, None, values, "v double").collect())[place]


def cutoff(packed: DataFrame, percent: float) -> float:
    """The distance at ``percent`` of all pairs of :func:`blocks`, by position."""
    n, *ends = span(packed)
    return distance_at(packed, min(n - 1, max(1, round(n * percent / 100))), (n, *ends)) if n else 0.0


def cutoff_counted(packed: DataFrame, points: int, percent: float = 2.0) -> float:
    """The distance at ``percent`` of all cells of the square matrix of distances, whose diagonal holds zeros: 0 where that is in the diagonal."""
    place = int(points * (points - 1) / 2 * percent / 100)
    return distance_at(packed, place - 1) if place else 0.0


def _halves(low: float, high: float, steps: int) -> list[float]:
    """The middles that ``steps`` halvings of an interval can meet."""
    mid = (low + high) / 2
    return [mid, *_halves(low, mid, steps - 1), *_halves(mid, high, steps - 1)] if steps else []


def cutoff_bisected(packed: DataFrame, low_share: float = 0.01, high_share: float = 0.02, width: float = 1e-4, steps: int = 4) -> float:
    """A distance below which between 1 and 2 % of the pairs lie, by halving an interval; ``steps`` halvings a pass over the pairs."""
    n, lo, hi = span(packed)
    below: dict[float, int] = {}
    while n and hi - lo > width:
        mid = (lo + hi) / 2
        if mid not in below:
            ends = sorted(set(_halves(lo, hi, steps)))

            def count(a: Block, b: Block) -> pa.Table:
                counts = np.zeros(len(ends), np.int64)
                for _, _, d2, _ in tiles(a, b):
                    d = np.sqrt(d2)
                    counts += [np.count_nonzero(d < e) for e in ends]
                return pa.table({"e": np.arange(len(ends)), "n": counts})

            below |= {ends[r.e]: r.n for r in met(packed, None, count, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).collect()}
        share = below[mid] / n
        if low_share <= share <= high_share:
            return mid
        lo, hi = (mid, hi) if share < low_share else (lo, mid)
    return (lo + hi) / 2 if n else 0.0


def densities(packed: DataFrame, dc: float, gaussian: bool = True) -> DataFrame:
    """(id, rho): partial sums of each pair of blocks for both ends of its pairs; a point without pairs has density 0."""
    dc = dc or 3e-5

    def work(a: Block, b: Block) -> pa.Table:
        (left,), (right,) = _by_both(a, b)
        for r, c, d2, _ in tiles(a, b):
            w = np.exp(d2 * (-1 / (dc * dc))) if gaussian else _near(a, b, r, c, d2, dc)
            left[r] += w.sum(1)
            right[c] += w.sum(0)
        return pa.table({"id": a.ids, "rho": left} if a is b else {"id": np.concatenate((a.ids, b.ids)), "rho": np.concatenate((left, right))})

    return met(packed, None, work, "id long, rho double").groupBy("id").agg(F.sum("rho").alias("rho"))


class _Nearest:
    """The nearest other point of each point of a block so far: its distance, ties by its id."""

    def __init__(self, block: Block):
        self.block, self.d, self.p = block, np.full(len(block), np.inf), np.full(len(block), np.iinfo(np.int64).max)

    def see(self, at: slice, other: Block, to: slice, d2: np.ndarray) -> None:
        """A tile of squares; infinite ones do not count. Those about as near as the nearest are compared by differences."""
        x, y, names, d, p = self.block.x[at], other.x[to], other.ids[to], self.d[at], self.p[at]
        low, room = d2.min(1, initial=np.inf), SLACK * (self.block.norms[at] + other.norms[to].max(initial=0))
        rows = np.flatnonzero((low < np.inf) & (low <= d * d + room))
        i, j = np.nonzero(d2[rows] <= (low + room)[rows, None])
        i = rows[i]
        e = np.sqrt(_exact(x, y, i, j))
        by = np.lexsort((names[j], e, i))
        by = by[np.flatnonzero(np.diff(i[by], prepend=-1))]
        i, e, n = i[by], e[by], names[j[by]]
        better = (e < d[i]) | ((e == d[i]) & (n < p[i]))
        d[i[better]], p[i[better]] = e[better], n[better]


def _nearest_denser(a: Block, b: Block) -> tuple[_Nearest, _Nearest, float]:
    """Of the points of two blocks, which have a rho, their nearest denser ones in the other, and the largest square of a distance."""
    ids, rho = np.concatenate((a.ids, b.ids)), np.concatenate((a["rho"], b["rho"]))
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids, -rho))] = np.arange(len(ids))
    ra, rb = (rank[: len(a)], rank[: len(a)]) if a is b else (rank[: len(a)], rank[len(a) :])
    left = _Nearest(a)
    right, far = left if a is b else _Nearest(b), -1.0
    for r, c, d2, holes in tiles(a, b):
        far = max(far, _largest(d2, holes))
        lower = ra[r][:, None] > rb[c]
        left.see(r, b, c, np.where(lower, d2, np.inf))
        right.see(c, a, r, np.where(lower, np.inf, d2).T)
    return left, right, far


def peaks(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, rho, delta, parent) of points with id, x and rho: distance to and name of the nearest denser point; ties by id.

    Denser: more density, or as much and a smaller id. The densest point has no parent, and the largest distance.
    """

    def work(a: Block, b: Block) -> pa.Table:
        left, right, far = _nearest_denser(a, b)
        found = [(s.block.ids[some], s.d[some], s.p[some]) for s in ([left] if a is b else [left, right]) for some in [s.p < np.iinfo(np.int64).max]]
        ids, d, p = (np.concatenate(v) for v in zip(*found, strict=True))
        # a row without id carries the largest distance
        last = pa.array([far**0.5 if far >= 0 else None], pa.float64())
        return pa.table({"id": pa.chunked_array([ids, pa.nulls(1, pa.int64())]), "d": pa.chunked_array([d, last]), "p": pa.chunked_array([p, pa.nulls(1, pa.int64())])})

    low = cut(met(blocks(points.select("id", "x", "rho"), block_rows), None, work, "id long, d double, p long").groupBy("id").agg(F.min(F.struct("d", "p")).alias("s"), F.max("d").alias("far")))
    far = low.where("id is null").select("far").first()
    return points.select("id", "rho").join(low.where("id is not null"), "id", "left").select("id", "rho", F.coalesce("s.d", F.lit(far and far[0]).cast("double")).alias("delta"), F.col("s.p").alias("parent"))


def gammas(p: DataFrame) -> DataFrame:
    """(…, gamma): product of both, each scaled to [0, 1]."""
    ends = p.agg(F.struct(F.min("rho"), F.max("rho"), F.min("delta"), F.max("delta")).alias("e")).scalar()
    e = lambda i: ends[f"col{i + 1}"]
    return p.withColumn("gamma", numeric.min_max(F.col("rho"), e(0), e(1)) * numeric.min_max(F.col("delta"), e(2), e(3)))


def assign(p: DataFrame, clusters: int) -> DataFrame:
    """(id, cluster): the points of largest gamma, all others like their parent, by pointer doubling."""
    top = p.orderBy(F.desc("gamma"), "id").limit(clusters).select("id").withColumn("top", F.lit(True))
    now = p.join(F.broadcast(top), "id", "left").select("id", F.when(F.col("top") | F.col("parent").isNull(), F.col("id")).otherwise(F.col("parent")).alias("to"))
    n = p.count()
    for _ in range(max(1, n.bit_length())):  # each step doubles what a pointer spans
        nxt = now.select(F.col("id").alias("to"), F.col("to").alias("further"))
        now = cut(now.join(nxt, "to").select("id", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.select("id", F.col("to").alias("cluster"))


def cluster_count(values: list[float]) -> int:
    """How many of the largest gammas stand out, by a change of the fitted Lomax law; 1 if none does.

    ``values``: at most 30 gammas, ascending. For each split whose left mean is clearly lower, both
    sides are fitted and the right part's scaled log-densities compared.
    """
    import math

    v, n = values, len(values)
    law = lambda part: ((s := min(part) or 1e-5), (lambda t: len(part) / t if t > 0 else -math.log(s))(sum(math.log((x or 1e-5) / s) for x in part)))
    best, at = 0.0, None
    for k in range(n // 2, n - 2):
        pre, post = v[:k], v[k:]
        if sum(pre) / len(pre) > 0.95 * sum(post) / len(post):
            continue
        (s0, a0), (s1, a1) = law(pre), law(post)
        if min(a0, a1) <= 0:
            continue
        f = [[math.log(a) - math.log(s) - (1 + a) * math.log(1 + x / s) for x in post] for s, a in ((s0, a0), (s1, a1))]
        scaled = [[(x - min(g)) / (max(max(g), 5e-324) - min(g)) if max(max(g), 5e-324) > min(g) else 0.0 for x in g] for g in f]
        skn = 0.0
        for x, y in zip(*scaled, strict=True):
            if x <= 0 or y <= 0:
                break
            skn += math.log(x / y)
        if skn > best:
            best, at = skn, k
    return n - 1 - at if at is not None and best >= -math.log(0.05) * 2 / n else 1


class BatchLearner:
    """A Spark ML learner fitted anew on all labelled points in each hop; ``fit``: rows with v and label -> model."""

    def __init__(self, fit=None):
        self.fit = fit or (lambda rows: DecisionTreeClassifier(featuresCol="v", labelCol="label", seed=1).fit(rows))
        self.known: DataFrame | None = None

    def learn(self, rows: DataFrame) -> None:
        rows = rows.select("id", array_to_vector("x").alias("v"), F.col("label").cast("double").alias("label"))
        self.known = cut(rows if self.known is None else self.known.unionByName(rows))

    def tell(self, rows: DataFrame, last: bool) -> DataFrame:
        told = self.fit(self.known).transform(rows.withColumn("v", array_to_vector("x")))
        return told.select("id", F.col("prediction").cast("int").alias("label"))


class NearestLearner:
    """The vote of the ``k`` nearest labelled points, by inverse distance."""

    def __init__(self, k: int = 5, block_rows: int = BLOCK_ROWS):
        self.k, self.block_rows, self.known = k, block_rows, None

    def learn(self, rows: DataFrame) -> None:
        rows = rows.select("id", "x", "label")
        self.known = cut(rows if self.known is None else self.known.unionByName(rows))

    def tell(self, rows: DataFrame, last: bool) -> DataFrame:
        return vote(k_nearest(rows, self.known, self.k, self.block_rows)).select("id", F.col("label").cast("int").alias("label"))


class OnlineLearner:
    """One online logistic learner that goes on from hop to hop and learns the points of each, in the order of their ids.

    Labels are 0 and 1: a point is 1 if its probability is ``threshold`` or more. Where that is
    nearer than ``unsure``, the point abstains and is asked again in the next hop, and at the end.
    The learner is sequential, as a stream is; a hop's points pass one task.
    """

    def __init__(self, threshold: float = 0.3, unsure: float = 0.0, **options):
        self.threshold, self.unsure, self.options, self.state = threshold, unsure, options, None

    def learn(self, rows: DataFrame) -> None:
        x = rows.select(F.lit(0).alias("key"), "id", F.concat(F.array(F.lit(1.0)), "x").alias("x"), "label")
        for r in online.learned(x, "key", "id", "x", "label", start_from=self.state, **self.options).collect():
            self.state = r.state.asDict()

    def tell(self, rows: DataFrame, last: bool) -> DataFrame:
        state = F.struct(F.array(*map(F.lit, self.state["z"])).alias("z"), F.lit(self.state["r"]).alias("r"))
        p = online.predict(state, F.concat(F.array(F.lit(1.0)), "x"), **{k: v for k, v in self.options.items() if k in ("l1", "l2", "lp")})
        asked = rows.select("id", p.alias("p"))
        sure = F.lit(True) if last else F.abs(F.col("p") - self.threshold) >= self.unsure
        return asked.select("id", F.when(sure, (F.col("p") >= self.threshold).cast("int")).alias("label"))


class TreeLearner:
    """A stream tree whose counts grow by the points of each hop instead of by arrival; labels are 0 and 1."""

    def __init__(self, tree: trees.StreamTree):
        self.tree = tree

    def _columns(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias(self.tree.row_id), *(F.get("x", F.lit(i)).alias(f) for i, f in enumerate(self.tree.features)), *([F.col("label").alias(self.tree.label)] if "label" in rows.columns else []))

    def learn(self, rows: DataFrame) -> None:
        self.tree.update(self._columns(rows))

    def tell(self, rows: DataFrame, last: bool) -> DataFrame:
        return self.tree.predict(self._columns(rows)).select(F.col(self.tree.row_id).alias("id"), F.col("predicted").alias("label"))


def spread_labels(p: DataFrame, labels: DataFrame, features: str = "x", fit=None, learner=None) -> DataFrame:
    """(id, label, hops): labels along the pointer graph, first to parents, then to children, a hop a round.

    ``p`` has id, parent and the features. In each hop a learner first learns the points that the
    hop before labelled, then labels those that the hop reaches; points on which it abstains wait.
    It goes on until a hop reaches no point; then those that still wait are labelled. ``learner``:
    one of the above, by default :class:`BatchLearner` with ``fit``.
    """
    points = cut(p.select("id", "parent", F.col(features).cast("array<double>").alias("x")))
    edges = points.where("parent is not null").select("id", "parent")
    known = cut(labels.select("id", F.col("label").cast("int").alias("label")).withColumn("hops", F.lit(0)))
    learner = learner or BatchLearner(fit)
    rows = points.drop("parent")
    news, hop = known, 0
    for source, target in (("id", "parent"), ("parent", "id")):
        front, waiting, last = known.select("id"), known.select("id").limit(0), False
        while True:
            # a hop only starts from what the hop before reached
            reached = edges.join(front.withColumnRenamed("id", source), source, "left_semi").select(F.col(target).alias("id"))
            asked = cut(reached.unionByName(waiting).distinct().join(known, "id", "left_anti"))
            if asked.isEmpty():
                break
            hop += 1
            if not news.isEmpty():
                learner.learn(rows.join(news, "id").select("id", "x", "label"))
            told = cut(learner.tell(rows.join(asked, "id"), last).withColumn("hops", F.lit(hop)))
            news = told.where("label is not null")
            # without news and without points beyond, the next hop is the last word for those that wait
            last = news.isEmpty()
            front, waiting = news.select("id"), told.where("label is null").select("id")
            known = cut(known.unionByName(news))
    return known


class PointerGraph:
    """Cutoff densities and nearest denser points of a growing set of points.

    A batch's points are held against all points; densities change only where a new point is near.
    Densities only grow, so an unchanged point keeps its denser points: it is held against the new
    and the changed ones alone. Only those are looked up anew among all. After each batch the graph
    is what :func:`densities` (without the Gaussian) and :func:`peaks` give for all points.
    """

    def __init__(self, dc: float, block_rows: int = BLOCK_ROWS):
        self.dc, self.block_rows, self.far = dc, block_rows, None
        self.points: DataFrame | None = None

    def add(self, batch: DataFrame) -> int:
        """One batch of (id, x), ids not seen before; how many of the points before changed their density."""
        dc, size = self.dc, self.block_rows
        new = cut(batch.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")))
        old = self.points if self.points is not None else new.limit(0).select("id", "x", F.lit(0.0).alias("rho"), F.lit(0.0).alias("delta"), F.lit(0).cast("long").alias("parent"))
        every = old.select("id", "x").unionByName(new)

        def count(a: Block, b: Block) -> pa.Table:
            """Of a block of new points against one of all: near ones of each end; a pair of new points is seen from both sides."""
            near, of, far = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), -1.0
            for r, c, d2, holes in tiles(a, b):
                at = _near(a, b, r, c, d2, dc)
                near[r] += at.sum(1)
                of[c] += at.sum(0)
                far = max(far, _largest(d2, holes))
            old_side = ~b["fresh"]
            ids, n = np.concatenate((a.ids, b.ids[old_side])), np.concatenate((near, of[old_side]))
            some = n > 0
            some[:1] = True  # carries the largest distance
            return pa.table({"id": ids[some], "near": n[some], "far": pa.array(np.full(some.sum(), max(far, 0.0) ** 0.5))})

        fresh = blocks(new.withColumn("fresh", F.lit(True)), size)
        beside = blocks(old.select("id", "x").withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True))), size)
        counted = cut(met(fresh, beside, count, "id long, near long, far double").groupBy("id").agg(F.sum("near").cast("double").alias("more"), F.max("far").alias("far")))
        far = counted.agg(F.max("far")).first()[0]
        self.far = max((f for f in (self.far, far) if f is not None), default=None)
        more = counted.where("more > 0").drop("far")
        rho = cut(every.join(old.select("id", "rho", "delta", "parent"), "id", "left").join(more, "id", "left").select(
            "id", "x", (F.coalesce("rho", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("rho"), "delta", "parent", (F.col("rho").isNull() | F.col("more").isNotNull()).alias("moved")))

        def denser(a: Block, b: Block) -> pa.Table:
            """Nearest denser points between a block of moved points and one of all, both ways."""
            left, right, _ = _nearest_denser(a, b)
            mine, others = left.d < np.inf, (right.d < np.inf) & ~b["moved"]
            return pa.table({"id": np.concatenate((a.ids[mine], b.ids[others])), "d": np.concatenate((left.d[mine], right.d[others])), "p": np.concatenate((left.p[mine], right.p[others]))})

        whole = rho.select("id", "x", "rho", "moved")
        found = met(blocks(whole.where("moved"), size), blocks(whole, size), denser, "id long, d double, p long")
        best = found.groupBy("id").agg(F.min(F.struct("d", "p")).alias("s"))
        held = F.when(~F.col("moved") & F.col("parent").isNotNull(), F.struct(F.col("delta").alias("d"), F.col("parent").alias("p")))
        both = rho.join(best, "id", "left").withColumn("s", F.least("s", held))
        self.points = cut(both.select("id", "x", "rho", F.coalesce("s.d", F.lit(self.far)).alias("delta"), F.col("s.p").alias("parent")))
        return rho.where("moved").count() - new.count()


def gamma_list(p: DataFrame, most: int = 30) -> list[float]:
    """At most ``most`` largest gammas, ascending."""
    return sorted(r[0] for r in p.orderBy(F.desc("gamma"), "id").limit(most).select("gamma").collect())


def ranked(p: DataFrame, most: int) -> DataFrame:
    """The ``most`` points of largest gamma with their rank, a report: only they reach the window."""
    top = p.orderBy(F.desc("gamma"), "id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gamma"), "id")))
