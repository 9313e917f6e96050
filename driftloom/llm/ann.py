"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors the graph of nearest neighbours is cut into parts of equal
size, a small network learns to tell a vector's part, and the number of parts that a query
visits is the least that reaches the wanted recall on the sample. The network then routes every
vector to its most probable part and every query to several; the vectors met there are reranked
by their inner products in double precision. Parts are cut into blocks of bounded size, so that
neither a part nor a vector with any number of copies makes a large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sample's bound, and the sample's vectors for each part; neighbours in the graph, hidden units; rows of a block.
SAMPLE, EACH, GRAPH_NEIGHBOURS, UNITS, BLOCK_ROWS = 6000, 32, 12, 96, 4096
#: Parts: one for each 7 of the square root of the rows, so that parts and what a query meets grow alike.
LEAST_PARTS, ROOT_SHARE = 32, 7
RECALL = 0.97


def nearest(q: np.ndarray, c: np.ndarray, k: int, same: bool = False) -> np.ndarray:
    """Indices of the k largest inner products, unordered; ``same``: without the vector itself."""
    out = np.empty((len(q), k), np.int64)
    for a in range(0, len(q), 1024):
        s = q[a : a + 1024] @ c.T
        if same:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = 1, sweeps: int = 30) -> np.ndarray:
    """A part for each node of the graph, no part above its equal share (rounded up, and one in twenty more).

    Parts grow around seeds by the neighbours they already hold, then nodes move to the part that
    holds most of their neighbours while it has room.
    """
    n = len(neighbours)
    room, r = int(np.ceil(n / parts * 1.05)), np.random.default_rng(seed)
    sides = np.concatenate((neighbours, np.full((n, 0), 0)), axis=1)
    ends = np.repeat(np.arange(n), sides.shape[1]), sides.ravel()
    part, size = np.full(n, -1), np.zeros(parts, np.int64)

    def votes() -> np.ndarray:
        v = np.zeros((n, parts), np.int32)
        for a, b in (ends, ends[::-1]):
            ok = part[b] >= 0
            np.add.at(v, (a[ok], part[b][ok]), 1)
        return v

    for p in range(parts):
        free = np.flatnonzero(part < 0)
        if not len(free):
            break
        v = np.zeros(n, np.int32)
        node = int(r.choice(free))
        for _ in range(n // parts):
            part[node] = p
            v[node] = -1_000_000
            v[neighbours[node]] += 1
            v[part >= 0] = -1_000_000
            node = int(np.argmax(v))
            if part[node] >= 0:
                break
    left = np.flatnonzero(part < 0)
    size = np.bincount(part[part >= 0], minlength=parts)
    for node in left:
        part[node] = int(np.argmin(size))
        size[part[node]] += 1
    for _ in range(sweeps):
        v = votes()
        best = v.argmax(1)
        gain = v[np.arange(n), best] - v[np.arange(n), part]
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if size[best[node]] < room:
                size[part[node]] -= 1
                size[best[node]] += 1
                part[node] = best[node]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer, trained on how the neighbours of each sample vector spread over the parts."""

    def __init__(self, x: np.ndarray, spread: np.ndarray, seed: int = 1, epochs: int = 60):
        r = np.random.default_rng(seed)
        d, p = x.shape[1], spread.shape[1]
        self.scale = np.float32(1 / max(1e-12, float(np.sqrt((x * x).mean()))))
        w = [r.standard_normal((d, UNITS)) * np.sqrt(2 / d), np.zeros(UNITS), r.standard_normal((UNITS, p)) * np.sqrt(1 / UNITS), np.zeros(p)]
        self.w = [v.astype(np.float32) for v in w]
        m, v, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), 256):
                at = order[a : a + 256]
                xb = x[at] * self.scale
                h = np.maximum(xb @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                dz = (z / z.sum(1, keepdims=True) - spread[at]) / len(at)
                dh = (dz @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.w[i] -= 0.004 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * self.scale) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]


def parts_for(rows: int) -> int:
    """How many parts a table of so many rows is cut into; :func:`fit` bounds it by what the sample can carry."""
    return max(LEAST_PARTS, int(rows**0.5) // ROOT_SHARE)


def fit(x: np.ndarray, k: int, parts: int = LEAST_PARTS, recall: float = RECALL) -> tuple[Router, int]:
    """The router, and how many parts a query visits to find ``recall`` of the k nearest in the sample."""
    x = x.astype(np.float32)
    parts = max(1, min(parts, len(x) // EACH))
    near = nearest(x, x, min(GRAPH_NEIGHBOURS, len(x) - 1), same=True) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
    part = balanced_parts(near, parts)
    spread = np.zeros((len(x), parts), np.float32)
    np.add.at(spread, (np.arange(len(x)), part), 1)
    np.add.at(spread, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
    router = Router(x, spread / spread.sum(1, keepdims=True))
    if parts == 1:
        return router, 1
    s = router.scores(x)
    home, order = s.argmax(1), np.argsort(-s, axis=1)
    far = np.argsort(order, axis=1)  # at which visit a part comes
    true = nearest(x, x, min(k, len(x) - 1), same=True)
    visit = np.take_along_axis(far, home[true], axis=1).ravel()
    found = np.cumsum(np.bincount(visit, minlength=parts)) / len(visit)
    return router, int(np.searchsorted(found, recall) + 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _route_batches(router: Router, visits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                s = router.scores(_matrix(b.column(1)).astype(np.float32))
                best = np.argsort(-s, axis=1, kind="stable")[:, :visits].astype(np.int32)
                at = np.arange(0, best.size + 1, best.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(best.ravel()))], names=["id", "v", "parts"])

    return work


def _rerank(k: int):
    def work(_, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        cid, qid = left["id"].to_numpy(), right["id"].to_numpy()
        c, q = (_matrix(t["v"].combine_chunks()).astype(np.float64) for t in (left, right))
        order = np.lexsort((cid,))
        cid, c = cid[order], c[order]
        # of equal vectors, only the k + 1 smallest ids can be among any query's k nearest
        _, same = np.unique(c, axis=0, return_inverse=True)
        by = np.argsort(same, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(same[by], same[by])
        stay = np.sort(by[rank <= k])
        cid, c = cid[stay], c[stay]
        out = []
        for a in range(0, len(q), 256):
            s = q[a : a + 256] @ c.T
            s[qid[a : a + 256, None] == cid[None, :]] = -np.inf
            if len(cid) > k:
                low = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                pick = (s >= low - 1e-9 * (1 + np.abs(low))) & (s > -np.inf)
            else:
                pick = s > -np.inf
            i, j = np.nonzero(pick)
            exact = np.zeros(len(i))
            for d in range(c.shape[1]):  # one order of summation, so that equal vectors score alike
                exact += q[a + i, d] * c[j, d]
            best = np.lexsort((cid[j], -exact, i))
            i, j, exact = i[best], j[best], exact[best]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((qid[a + i[top]], cid[j[top]], exact[top]))
        return pa.table({n: pa.array(np.concatenate([o[m] for o in out])) for m, n in enumerate(empty)})

    return work


def search(
    vectors: DataFrame, queries, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = SAMPLE, parts: int | None = None, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``queries`` holds.

    ``queries`` is a column expression over the id, named id. Nearness is the inner product, in
    double precision; ties go to the smaller id; a query does not find its own id. Rows with a null
    id, and vectors that are null, zero, of another than the most frequent length, or have null or
    non-finite components take no part; rows that repeat an id and vector count once. With fewer
    than k others all are found. No vectors or no queries: an empty result. ``parts``: by default
    they grow with the square root of the rows, up to one for each ``EACH`` vectors of the sample.
    """
    real = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & real)
    lengths = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return clean.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    # before blocks take their k nearest, so that no repeated row takes the place of another
    clean = clean.where(F.size("v") == lengths["d"]).dropDuplicates(["id", "v"])
    some = clean.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column(0).combine_chunks()
    router, visits = fit(_matrix(some), k, parts or parts_for(lengths["n"]), recall)
    schema = "id long, v array<double>, parts array<int>"
    home = clean.mapInArrow(_route_batches(router, 1), schema).select("id", "v", F.get("parts", 0).alias("part"))
    asked = clean.where(queries).mapInArrow(_route_batches(router, visits), schema).select("id", "v", F.explode("parts").alias("part"))
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
    # one row for each part, and there are at most ``parts`` of them
    plan = F.broadcast(blocks(home, "cs").join(blocks(asked, "qs"), "part"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = home.join(plan, "part").select("part", place("cs").alias("c"), upto("qs").alias("q"), "id", "v")
    right = asked.join(plan, "part").select("part", upto("cs").alias("c"), place("qs").alias("q"), "id", "v")
    keys = ["part", "c", "q"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_rerank(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
