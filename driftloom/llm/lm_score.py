"""Scoring documents with a gated recurrent language model, beside smoothed word counts.

Words are counted over all training documents. The most frequent words, a fixed number, go to
every task with their counts; all others are looked up by a join, one row for each occurrence.
The recurrent model sees the ``VOCABULARY`` most frequent words, an end mark and one mark for
every rarer word, whose own probability then follows the counts, so that the model is a
distribution over all words. Its output is a softmax over classes times a softmax within the
class.

Training is synchronous: in each round every trainer starts from the same parameters, runs Adam
with truncated back-propagation over its share of the training documents, and the parameters are
averaged. A trainer has ``BATCH`` lanes; each takes a document, window after window of ``WINDOW``
tokens, the last as short as what is left with the end mark, and carries the state from one window
to the next, so that training sees the states that scoring is in. Every token and every end is a
target once. Documents beyond ``SEGMENT`` tokens are learned from in segments, each from an empty
state. Shares, order and seeds follow from hashes of id and text, not from partitions. Scoring
carries the state from the first token of a document to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch, slices, utf8, word_hashes, words

END, RARE = 0, 1
VOCABULARY, CLASS_SIZE, HIDDEN = 1022, 32, 16
#: Words whose counts every task holds: 16 bytes each, whatever the corpus.
LOOKED_UP = 200_000
WINDOW, BATCH, ROUNDS, RATE = 32, 128, 3, 0.01
#: Tokens of a document that follow one another in a lane, and tokens of a trainer in a round: the trainers grow in number with the corpus.
SEGMENT, TOKENS_EACH = 32 * WINDOW, 1_200_000
SCORED_TOGETHER, STEPS_TOGETHER = 512, 64
_SHAPES = {
    "embed": (VOCABULARY + 2, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
    "wc": (HIDDEN, (VOCABULARY + 2) // CLASS_SIZE), "bc": ((VOCABULARY + 2) // CLASS_SIZE,),
    "ww": ((VOCABULARY + 2) // CLASS_SIZE, HIDDEN, CLASS_SIZE), "bw": ((VOCABULARY + 2) // CLASS_SIZE, CLASS_SIZE),
}


def initial(counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small weights, and biases with which the model starts as the distribution of ``counts``."""
    r = np.random.default_rng(seed)
    p = {k: (r.standard_normal(s) * 0.1).astype(np.float32) for k, s in _SHAPES.items()}
    n = (counts + 1.0).reshape(-1, CLASS_SIZE)
    p["bc"] = np.log(n.sum(1) / n.sum()).astype(np.float32)
    p["bw"] = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
    p["b"][:] = 0
    p["wc"] *= 0.1
    p["ww"] *= 0.1
    return p


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def _gates(w: tuple[np.ndarray, np.ndarray], x: np.ndarray, h: np.ndarray, out: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """One step, each column a sequence: gate inputs and old states to gates, candidates and new states (``out``).

    Columns keep the rows of a gate together in memory; exp may overflow, to a gate of 0.
    """
    gates, c, new = out
    n = HIDDEN
    np.matmul(w[0], h, out=gates)
    gates += x[: 2 * n]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.matmul(w[1], gates[n:] * h, out=c)
    c += x[2 * n :]
    np.tanh(c, out=c)
    np.subtract(c, h, out=new)
    new *= gates[:n]
    new += h


def _recurrent(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The weights of :func:`_gates`."""
    return np.ascontiguousarray(p["wh"][:, : 2 * HIDDEN].T), np.ascontiguousarray(p["wh"][:, 2 * HIDDEN :].T)


def step(p: dict[str, np.ndarray], table: np.ndarray, ids: np.ndarray, h: np.ndarray):
    """New states (rows), gates and candidates (columns). ``table`` holds each word's input to the gates."""
    x, h = table[ids].T, h.T
    gates, c, new = (np.empty((n, len(ids)), np.result_type(x, h)) for n in (2 * HIDDEN, HIDDEN, HIDDEN))
    with np.errstate(over="ignore"):
        _gates(_recurrent(p), x, h, (gates, c, new))
    return new.T, (gates, c)


def gate_inputs(p: dict[str, np.ndarray]) -> np.ndarray:
    return p["embed"] @ p["wx"] + p["b"]


def _chosen(x: np.ndarray, target: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-softmax down the columns at each column's target, and if asked for the gradient of its negative. ``x`` is used up."""
    rows = np.arange(x.shape[1])
    x -= x.max(0)
    score = x[target, rows]
    e = np.exp(x, out=x)
    total = e.sum(0)
    score -= np.log(total)
    if not gradient:
        return score, None
    e /= total
    e[target, rows] -= 1
    return score, e


def output(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray, grads: dict | None = None):
    """Natural log-probability of each target after its state (a row); with ``grads``, also the gradient for the states."""
    score, back = _output(p, h.T, target, grads)
    return score, None if back is None else back.T


def _output(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray, grads: dict | None = None):
    """:func:`output` with states as columns."""
    kind = (target // CLASS_SIZE).astype(np.int16)
    order = np.argsort(kind, kind="stable")
    # targets of a class lie together
    kind, inside, h = kind[order], (target % CLASS_SIZE)[order], np.take(h, order, axis=1)
    cuts = np.searchsorted(kind, np.arange(len(p["bc"]) + 1))
    score, d = _chosen(p["wc"].T @ h + p["bc"][:, None], kind, grads is not None)
    back = None
    if grads is not None:
        grads["wc"] += h @ d.T
        grads["bc"] += d.sum(1)
        back = p["wc"] @ d
    some = np.flatnonzero(np.diff(cuts))
    x = np.empty((CLASS_SIZE, len(kind)), score.dtype)
    for k in some:
        at = slice(cuts[k], cuts[k + 1])
        x[:, at] = p["ww"][k].T @ h[:, at]
        x[:, at] += p["bw"][k][:, None]
    more, d = _chosen(x, inside, grads is not None)
    score += more
    if grads is not None:
        grads["bw"][some] += np.add.reduceat(d, cuts[some], axis=1).T
        for k in some:
            at = slice(cuts[k], cuts[k + 1])
            grads["ww"][k] += h[:, at] @ d[:, at].T
            back[:, at] += p["ww"][k] @ d[:, at]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return score[place], None if back is None else np.take(back, place, axis=1)


def _sum_by(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of ``rows`` that share an id, for ids up to ``n``."""
    order = np.argsort(ids.astype(np.int16), kind="stable")
    some = ids[order]
    first = np.flatnonzero(np.diff(some, prepend=-1))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[some[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def loss_and_gradients(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, real: np.ndarray | None = None, h: np.ndarray | None = None):
    """Mean negative log-likelihood of windows (steps x batch) from the states ``h`` (by default empty), its gradients, and the last states.

    Only the targets that are ``real`` count; what is not stands behind a window's end.
    """
    steps, batch = inputs.shape
    n = HIDDEN
    real = np.ones(inputs.shape, bool) if real is None else real
    g = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    x = np.ascontiguousarray(gate_inputs(p)[inputs].transpose(0, 2, 1))
    states, gates, c = (np.empty((m, k, batch), x.dtype) for m, k in ((steps + 1, n), (steps, 2 * n), (steps, n)))
    states[0] = 0 if h is None else h.T
    w = _recurrent(p)
    with np.errstate(over="ignore"):
        for t in range(steps):
            _gates(w, x[t], states[t], (gates[t], c[t], states[t + 1]))
    at = np.flatnonzero(real)
    columns = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], -1)
    score, some = _output(p, np.take(columns(states[1:]), at, axis=1), targets.ravel()[at], g)
    back = np.zeros((n, steps * batch), some.dtype)
    back[:, at] = some
    back = np.ascontiguousarray(back.reshape(n, steps, batch).transpose(1, 0, 2))
    # what does not depend on later steps, for all steps at once
    h0, z, r = states[:-1], gates[:, :n], gates[:, n:]
    stay = 1 - z
    for_z, for_r, for_c = (c - h0) * z * stay, h0 * r * (1 - r), z * (1 - c * c)
    wz, wn = p["wh"][:, : 2 * n], p["wh"][:, 2 * n :]
    d, dh = np.empty_like(x), np.zeros((n, batch), x.dtype)
    for t in range(steps - 1, -1, -1):
        dh += back[t]
        drh = wn @ np.multiply(dh, for_c[t], out=d[t, 2 * n :])
        np.multiply(dh, for_z[t], out=d[t, :n])
        np.multiply(drh, for_r[t], out=d[t, n : 2 * n])
        dh *= stay[t]
        drh *= r[t]
        dh += drh
        dh += wz @ d[t, : 2 * n]
    flat = columns(d)
    g["wh"][:, 2 * n :] += columns(r * h0) @ flat[2 * n :].T
    g["wh"][:, : 2 * n] += columns(h0) @ flat[: 2 * n].T
    g["b"] += flat.sum(1)
    rows = np.ascontiguousarray(d.transpose(0, 2, 1)).reshape(-1, 3 * n)
    g["wx"] += np.take(p["embed"], inputs.ravel(), axis=0).T @ rows
    g["embed"] += _sum_by(inputs.ravel(), rows @ p["wx"].T, VOCABULARY + 2)
    total = len(score)
    return -float(score.mean()), {k: v / total for k, v in g.items()}, states[-1].T


class Adam:
    """Moments of all parameters in one array each, in the order of ``_SHAPES``."""

    def __init__(self, p, rate=RATE):
        flat = pack(p)
        self.m, self.v, self.t, self.rate = np.zeros_like(flat), np.zeros_like(flat), 0, rate

    def update(self, p, g, share: float = 1.0) -> None:
        """``share``: how large a part of a full batch the gradient stands for."""
        self.t += 1
        g = pack(g)
        self.m += 0.1 * (g - self.m)
        g *= g
        g -= self.v
        g *= 0.01
        self.v += g
        below = np.sqrt(np.divide(self.v, 1 - 0.99**self.t, out=g), out=g)
        below += 1e-8
        step = self.m / (1 - 0.9**self.t)
        step *= share * self.rate
        step /= below
        at = 0
        for k in _SHAPES:
            p[k] -= step[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size


def document_scores(p: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole id sequence, its state carried from start to end."""
    table, w, out = np.ascontiguousarray(gate_inputs(p).T), _recurrent(p), np.zeros(len(docs))
    sizes = np.array([len(d) for d in docs])
    order = np.argsort(-sizes, kind="stable")
    for a in range(0, len(order), SCORED_TOGETHER):
        some = order[a : a + SCORED_TOGETHER]
        h, last = np.zeros((HIDDEN, len(some)), np.float32), np.full(len(some), END)
        longest = sizes[some[0]]
        for t0 in range(0, longest, STEPS_TOGETHER):
            live = int((sizes[some] > t0).sum())
            h, last = np.ascontiguousarray(h[:, :live]), last[:live]
            width = min(STEPS_TOGETHER, longest - t0)
            real = np.arange(t0, t0 + width)[:, None] < sizes[some[:live]]
            ids = np.zeros((live, width), np.int64)
            ids[real.T] = np.concatenate([docs[i][t0 : t0 + width] for i in some[:live]])
            ids = np.ascontiguousarray(ids.T)
            states = np.empty((width, HIDDEN, live), np.float32)
            gates, c = np.empty((2 * HIDDEN, live), np.float32), np.empty((HIDDEN, live), np.float32)
            with np.errstate(over="ignore"):
                for t in range(width):
                    _gates(w, np.take(table, last, axis=1), h, (gates, c, states[t]))
                    h, last = states[t], ids[t]
            at = np.flatnonzero(real)
            score = np.zeros(width * live)
            score[at] = _output(p, np.take(states.transpose(1, 0, 2).reshape(HIDDEN, -1), at, axis=1), ids.ravel()[at])[0]
            out[some[:live]] += score.reshape(width, live).sum(0)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, n = [], 0

    def counted() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "n"])

    for whole in batches:
        for batch in slices(whole, 0):
            body, at = utf8(batch.column(0))
            starts, ends, _ = words(body, at)
            waiting.append(word_hashes(body, starts, ends))
            n += len(starts)
            if n > 6_000_000:
                yield counted()
                waiting, n = [], 0
    if n:
        yield counted()


def _encode_batches(hashes: np.ndarray, counts: np.ndarray, ranks: np.ndarray):
    """hashes ascending, with the count of each and its place by frequency."""
    logs = np.log10(counts + 1.0)
    ids = np.where(ranks < VOCABULARY, ranks + 2, RARE).astype(np.int16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                body, at = utf8(batch.column(2))
                starts, ends, first = words(body, at)
                h = word_hashes(body, starts, ends)
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    known = hashes[place] == h
                    log = np.where(known, logs[place], 0.0)
                    word = np.where(known, ids[place], RARE)
                else:
                    known, log, word = np.zeros(len(h), bool), np.zeros(len(h)), np.full(len(h), RARE)
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
                n = len(batch)
                tokens = np.insert(word, first[1:], END).astype(np.int16)
                token_at = first + np.arange(n + 1)
                tail_at = np.concatenate(([0], np.cumsum(sums(~known)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(np.diff(token_at)),
                        pa.array(sums(known).astype(np.int64)), pa.array([float(log[a:b].sum()) for a, b in zip(first[:-1], first[1:], strict=True)]),
                        pa.array([float(log[a:b][word[a:b] == RARE].sum()) for a, b in zip(first[:-1], first[1:], strict=True)]),
                        pa.array(sums(word == RARE).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(token_at.astype(np.int32)), pa.array(tokens)),
                        pa.ListArray.from_arrays(pa.array(tail_at), pa.array(h[~known].view(np.int64))),
                    ],
                    names=["row", "held_out", "n_tokens", "known", "log_known", "log_rare", "n_rare", "ids", "tail"],
                )

    return work


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, part, segment) for the segments of each document, each with the token before in front, the first with an end mark."""
    for batch in batches:
        seeds, parts, out = [], [], []
        for seed, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.concatenate(([END], ids.values.to_numpy(zero_copy_only=False))).astype(np.int16)
            for part, a in enumerate(range(0, len(ids) - 1, SEGMENT)):
                seeds.append(seed)
                parts.append(part)
                out.append(ids[a : a + SEGMENT + 1])
        at = np.cumsum([0, *map(len, out)]).astype(np.int32)
        body = np.concatenate([*out, np.zeros(0, np.int16)]).astype(np.int16)
        yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(body))], names=["seed", "part", "segment"])


def _block(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as columns, filled up behind their ends, and which targets are real."""
    sizes = np.array([len(w) for w in windows])
    ids = np.full((sizes.max(), len(windows)), END, np.int64)
    for j, w in enumerate(windows):
        ids[: len(w), j] = w
    return ids, np.arange(1, sizes.max())[:, None] < sizes


class _Lanes:
    """Up to ``BATCH`` segments side by side, each with its state and how far it is read."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.adam, self.updates = p, Adam(p), 0
        self.lanes: list[np.ndarray] = []
        self.at = np.zeros(0, np.int64)
        self.h = np.zeros((0, HIDDEN), np.float32)

    def full(self) -> bool:
        return len(self.lanes) >= BATCH

    def add(self, segment: np.ndarray) -> None:
        self.lanes.append(segment)
        self.at = np.append(self.at, 0)
        self.h = np.concatenate((self.h, np.zeros((1, HIDDEN), np.float32)))

    def learn(self) -> None:
        """One window of each lane; lanes that are read to their end are free again."""
        block, real = _block([x[a : a + WINDOW + 1] for x, a in zip(self.lanes, self.at.tolist(), strict=True)])
        _, g, h = loss_and_gradients(self.p, block[:-1], block[1:], real, self.h)
        self.adam.update(self.p, g, real.sum() / (WINDOW * BATCH))
        self.updates += int(real.sum())
        self.at += WINDOW
        live = [i for i, x in enumerate(self.lanes) if self.at[i] < len(x) - 1]
        self.lanes, self.at, self.h = [self.lanes[i] for i in live], self.at[live], h[live]


def _train_batches(flat: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _Lanes(unpack(flat))
        for batch in batches:
            column = batch.column(2)
            body, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for a, b in zip(at[:-1], at[1:], strict=True):
                while lanes.full():
                    lanes.learn()
                lanes.add(body[a:b])
        while lanes.lanes:
            lanes.learn()
        if lanes.updates:
            yield pa.RecordBatch.from_arrays([pa.array([lanes.updates], pa.int64()), pa.array([pack(lanes.p)], pa.list_(pa.float32()))], names=["updates", "p"])

    return work


def _score_batches(flat: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, rows, docs, n = unpack(flat), [], [], 0

        def scored() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(document_scores(p, docs))], names=["row", "log_model"])

        for batch in batches:
            for row, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append(row)
                docs.append(ids.values.to_numpy(zero_copy_only=False))
                n += len(docs[-1])
                if n > 16_000_000:
                    yield scored()
                    rows, docs, n = [], [], 0
        if rows:
            yield scored()

    return work


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The scores do not depend on how ``docs`` is partitioned, but for the last digits of float sums.

    Tokens are the lower-cased (A-Z) words and one end. Held out are ids whose text's crc32 leaves
    2 when divided by 7; a null id trains. Null or blank text is the end alone. Scores are log10
    probabilities. Repeated rows are scored alike (and counted as often as they occur). An empty
    table gives an empty result; without training documents all words are unknown.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))
    slim = docs.select(F.col(doc_id).alias("id"), held.alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    learn = slim.where("not held_out")
    counts = scratch.write(learn.select("text").mapInArrow(_count_batches, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = learn.count()
    n_all, v_all = total + ends, distinct + (ends > 0)
    # the least count that no more than LOOKED_UP words reach, from the few distinct counts there are
    level = counts.groupBy("n").agg(F.count("*").alias("k")).withColumn("above", F.sum("k").over(Window.orderBy(F.desc("n"))))
    least = level.where(F.col("above") <= LOOKED_UP).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= F.lit(least)).toPandas().sort_values(["n", "h"], ascending=[False, True])
    order = np.argsort(top["h"].to_numpy().view(np.uint64), kind="stable")
    hashes, often = top["h"].to_numpy().view(np.uint64)[order], top["n"].to_numpy()[order]
    by_rank = top["n"].to_numpy()[:VOCABULARY].astype(np.int64)
    n_rare, v_rare = int(total - by_rank.sum()), distinct - len(by_rank)

    seed = F.xxhash64("id", "text")
    keyed = slim.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text", seed.alias("seed"))
    kind = keyed.schema["id"].dataType.simpleString()
    whole = keyed.select("row", F.struct("id", "held_out", "seed").alias("who"), "text").mapInArrow(
        _encode_batches(hashes, often, order),
        f"row long, who struct<id:{kind},held_out:boolean,seed:bigint>, n_tokens long, known long, log_known double, log_rare double, n_rare long, ids array<smallint>, tail array<long>",
    )
    table = scratch.write(whole)

    first = np.zeros(VOCABULARY + 2)
    first[END], first[RARE], first[2 : 2 + len(by_rank)] = ends, n_rare, by_rank
    flat = pack(initial(first))
    taught = table.where("not who.held_out")
    segments = scratch.write(taught.select("who.seed", "ids").mapInArrow(_segment_batches, "seed long, part int, segment array<smallint>"))
    trainers = 1 + (taught.agg(F.sum("n_tokens")).first()[0] or 0) // (ROUNDS * TOKENS_EACH)
    draw = F.xxhash64("seed", "part")
    for r in range(ROUNDS):
        share = segments.where(F.pmod(draw, F.lit(ROUNDS)) == r).withColumn("draw", F.xxhash64(F.lit(r), draw)).repartition(trainers, "draw")
        share = share.sortWithinPartitions("draw", "seed", "part").select("seed", "part", "segment")
        found = share.mapInArrow(_train_batches(flat), "updates long, p array<float>").select("updates", F.posexplode("p").alias("i", "x"))
        # averaged by the cluster: the driver gets one set of parameters, however many trainers there are
        mean = found.groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("updates")) / F.sum("updates")).alias("x")).toPandas()
        if len(mean):
            flat = mean.sort_values("i")["x"].to_numpy().astype(np.float32)

    # where the documents lie; each task brings those of like length together itself
    scores = table.select("row", "ids").mapInArrow(_score_batches(flat), "row long, log_model double")
    tail = table.select("row", F.explode("tail").alias("h")).join(counts, "h")
    tail = tail.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("log_tail"))
    both = table.select("row", "who", "n_tokens", "known", "log_known", "log_rare", "n_rare").join(scores, "row").join(tail, "row", "left")
    log_tail = F.coalesce("log_tail", F.lit(0.0))
    base = F.col("log_known") + log_tail + float(np.log10(ends + 1.0)) - F.col("n_tokens") * float(np.log10(n_all + v_all + 1.0))
    model = F.col("log_model") / float(np.log(10.0)) + F.col("log_rare") + log_tail - F.col("n_rare") * float(np.log10(n_rare + v_rare + 1.0))
    return both.select(
        F.col("who.id").alias(doc_id),
        F.col("who.held_out").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model.alias("score"),
    )
