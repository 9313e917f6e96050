"""Removing byte strings that occur more than once, by column-wise suffix sorting of many documents.

A collection's order is built as in external multi-document BWT construction: in each round every
string contributes one more symbol to its left, one stable sort by that symbol turns the order of
the suffixes so far into the order of the longer ones, and common prefixes of neighbours follow
from range minima over the round before. What keeps the rounds few and sequential is alignment:

* Every window of ``length`` bytes has an anchor, the leftmost smallest hash among its
  ``gram``-byte strings, a function of the window's content alone. Equal windows have equal
  anchors at equal places. Windows that share an anchor in a text are neighbours and make one
  piece; pieces whose anchor occurs nowhere else have no repeats and are never looked at again.
* The remaining pieces are laid over one another with their anchors in one column. Only suffixes
  that begin in the same column can be equal windows, so a round sorts one column: the order and
  the common prefixes of all pieces of a block are two small arrays, rewritten once for each
  column, from blocks that the shuffle has put into sequential files by anchor.

A window is repeated if a neighbour in its column's order shares ``length`` symbols with it.

* Equal texts are one text with a number of copies, told apart by 128 bits of hash; all of a text
  with copies is repeated.
* A periodic stretch gives equal pieces one after the other. They are one piece and a run: each of
  its windows starts again a period on.
* Pieces of an anchor that occurs more than ``CROWD`` times are not brought together. Distinct
  pieces are taken first, and their windows are counted by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch, mix, slices, utf8

LENGTH, GRAM = 200, 64
#: Pieces that are sorted together, unless more share an anchor, and the most that may.
BLOCK, CROWD = 8192, 1 << 16
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE = mix(np.arange(3, 259, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS: dict[int, np.ndarray] = {}
_PLACE = np.uint64(31)  # bits for a place in a text


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 1 << 16), np.uint64(base)))), dtype=np.uint64)
    return _POWERS[base][:n]


def gram_hashes(body: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, by differences of a running polynomial."""
    n = len(body)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[body] * _powers(_BASE, n), out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours: running minima forwards and backwards within blocks."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _same_as_next(body: np.ndarray, row: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Whether a piece has the bytes of the one that follows it in its row."""
    like = (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & (np.diff(last - first) == 0) & (np.diff(place - first) == 0) & (first[1:] == last[:-1] + 1)
    same = np.zeros(len(row), bool)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], like, [False])).astype(np.int8)))
    for a, z in zip(edges[0::2], edges[1::2], strict=True):  # pieces a to z are alike, each as long as the step to the next
        step = int(first[a + 1] - first[a])
        start, stop = int(first[a]), int(last[z] + length)
        other = np.concatenate(([0], np.cumsum(body[start : stop - step] != body[start + step : stop])))
        at = first[a:z] - start
        same[a:z] = other[at + step - 1 + length] == other[at]
    return same


def anchors(body: np.ndarray, at: np.ndarray, length: int, gram: int):
    """For each piece of the rows: its row, anchor hash, first window, last window, the anchor's place and the last window of its run, all within the row."""
    none = np.zeros(0, np.int64)
    if len(body) < length:
        return (none,) * 6
    h = gram_hashes(body, gram)
    # a content hash above the place: the smallest is the leftmost of the smallest
    ranked = (h >> _PLACE) << _PLACE | np.arange(len(h), dtype=np.uint64)
    place = (sliding_min(ranked, length - gram + 1) & np.uint64((1 << 31) - 1)).astype(np.int64)
    starts = np.arange(len(place))
    row = np.searchsorted(at, starts, "right") - 1
    inside = starts + length <= at[row + 1]
    starts, row, place = starts[inside], row[inside], place[inside]
    if not len(starts):
        return (none,) * 6
    new = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(row, prepend=-1))
    last = starts[np.concatenate((new[1:], [len(starts)])) - 1]
    first, row, place = starts[new], row[new], place[new]
    anchor = h[place].view(np.int64)
    same = _same_as_next(body, row, anchor, first, last, place, length)
    heads = np.flatnonzero(~np.concatenate(([False], same[:-1])))
    until = last[np.concatenate((heads[1:], [len(row)])) - 1]
    row = row[heads]
    return row, anchor[heads], first[heads] - at[row], last[heads] - at[row], place[heads] - at[row], until - at[row]


def repeated_windows(pieces: list[bytes], before: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """For each piece a row of booleans: which windows, by column, are repeated in the collection.

    ``before``: bytes of each piece in front of its anchor. Column ``max(before) + j`` of a piece
    is its byte ``before + j``; a window is named by the column in which it begins.
    """
    m, left = len(pieces), int(before.max())
    sizes = np.array([len(p) for p in pieces])
    width = int((left - before + sizes).max())
    symbols = np.zeros((width, m), np.uint16)
    for i, p in enumerate(pieces):
        symbols[left - before[i] : left - before[i] + len(p), i] = np.frombuffer(p, np.uint8)
        symbols[left - before[i] : left - before[i] + len(p), i] += 1
    order, shared = np.arange(m), np.zeros(m, np.int32)
    out = np.zeros((m, width), bool)
    for column in range(width - 1, -1, -1):
        now = symbols[column][order]
        turn = np.argsort(now, kind="stable")
        # the common prefix of two that come to stand together: all that lay between them shared it
        same = np.zeros(m, bool)
        same[1:] = (now[turn[1:]] == now[turn[:-1]]) & (now[turn[1:]] > 0)
        k = np.flatnonzero(same)
        longer = np.zeros(m, np.int32)
        if len(k):
            ends = np.empty(2 * len(k), np.int64)
            ends[0::2], ends[1::2] = turn[k - 1] + 1, turn[k] + 1
            padded = np.append(shared, np.int32(0))
            longer[k] = np.minimum.reduceat(padded, ends)[0::2] + 1
        order, shared = order[turn], longer
        if width - column >= length:
            hit = shared >= length
            if hit.any():
                both = hit.copy()
                both[:-1] |= hit[1:]
                out[order[both], column] = True
    for i in np.flatnonzero(copies > 1):
        out[i, left - before[i] : left - before[i] + sizes[i] - length + 1] = True
    return out


def _anchor_batches(length: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                row, anchor, *rest = anchors(*utf8(b.column(1)), length, gram)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(anchor), *(pa.array(x.astype(np.int32)) for x in rest)], names=["k", "anchor", "first", "last", "place", "until"])

    return work


def _cut_batches(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                out = []
                for k, text, copies, spots in zip(*(b.column(i) for i in range(4)), strict=True):
                    data, k, copies = memoryview(text.as_buffer()), k.as_py(), copies.as_py()
                    for s in spots.as_py():
                        many = max(copies, 2) if s["until"] > s["last"] else copies
                        out.append((k, s["first"], s["anchor"], s["place"] - s["first"], many, bytes(data[s["first"] : s["last"] + length])))
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["k", "first", "anchor", "before", "copies", "piece"])

    return work


def _window_batches(length: int):
    """(w1, w2, p1, p2, s, copies) for each window of each piece (p1, p2, copies, piece)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 256):
                b = whole.slice(a, 256)
                pieces = [x.as_py() for x in b.column(3)]
                sizes = np.array([len(x) - length + 1 for x in pieces])
                digests = b"".join(hashlib.blake2b(x[i : i + length], digest_size=16).digest() for x in pieces for i in range(len(x) - length + 1))
                w = np.frombuffer(digests, np.int64).reshape(-1, 2)
                of = pa.array(np.repeat(np.arange(len(pieces)), sizes))
                s = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes] or [np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), b.column(0).take(of), b.column(1).take(of), pa.array(s), b.column(2).take(of)],
                    names=["w1", "w2", "p1", "p2", "s", "copies"],
                )

    return work


def _block(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Repeated runs of the occurrences (k, first, anchor, before, copies, piece)."""
    seen: dict[tuple, int] = {}
    which = np.array([seen.setdefault((r[5], r[3]), len(seen)) for r in rows])
    copies = np.bincount(which, weights=[r[4] for r in rows]).astype(np.int64)
    before = np.array([b for _, b in seen])
    found = repeated_windows([p for p, _ in seen], before, copies, length)
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    runs: dict[int, list[tuple[int, int]]] = {}
    left = int(before.max())
    for (i, a), (_, z) in zip(np.argwhere(edge == 1), np.argwhere(edge == -1), strict=True):
        shift = left - before[i]
        runs.setdefault(int(i), []).append((int(a - shift), int(z - shift - 1 + length)))
    out = [(r[0], r[1] + a, r[1] + z) for r, i in zip(rows, which.tolist(), strict=True) for a, z in runs.get(i, ())]
    cols = list(zip(*out, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["k", "start", "stop"])


def _sort_batches(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if len(rows) >= BLOCK and row[2] != rows[-1][2]:
                    yield _block(rows, length)
                    rows = []
                rows.append(row)
        if rows:
            yield _block(rows, length)

    return work


def _clean_batches(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                out = []
                for text, copies, spans in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    data, kept, merged, end = text.as_buffer().to_pybytes(), [], [], 0
                    if copies > 1 and len(data) >= length:
                        spans = [{"start": 0, "stop": len(data)}]
                    for s in sorted(spans or (), key=lambda s: s["start"]):
                        if merged and s["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["stop"])
                        else:
                            merged.append([s["start"], s["stop"]])
                    for a, z in merged:
                        kept.append(data[end:a])
                        end = z
                    kept.append(data[end:])
                    out.append((len(data), sum(z - a for a, z in merged), [x for x, _ in merged], [x for _, x in merged], hashlib.sha256(b"".join(kept)).hexdigest()))
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["k", "n_bytes", "n_removed", "starts", "stops", "kept_sha256"])

    return work


def _keyed(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """``slim`` with k, one number for each distinct text: its hash, or, where texts share that, another hash."""
    k = F.xxhash64("text")
    for seed in range(1, 5):
        hashed = slim.select(k.alias("k"), F.xxhash64(F.lit(-seed), "text").alias("k2"))
        clash = hashed.groupBy("k").agg(F.min("k2").alias("a"), F.max("k2").alias("z")).where("a <> z").select("k")
        if clash.isEmpty():
            return slim.withColumn("k", k)
        # of n texts about n * n / 2 ** 65 clash: few, whatever the corpus
        clash = scratch.write(clash)
        slim = slim.withColumn("k", k).join(F.broadcast(clash.withColumn("clash", F.lit(True))), "k", "left")
        slim = slim.withColumn("_k", F.when(F.col("clash"), F.xxhash64(F.lit(seed), "text")).otherwise(F.col("k"))).select("id", "text", "_k")
        k = F.col("_k")
    raise ValueError("texts keep clashing")


def _crowded_runs(pieces: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(k, start, stop) of repeated runs among pieces of crowded anchors, by counts of their windows.

    Equal windows have their anchors at equal places, so windows of pieces with other anchors need
    no comparing, and counts over all pieces at once are the same.
    """
    named = pieces.withColumns({"p1": F.xxhash64("piece"), "p2": F.xxhash64(F.lit(7), "piece")})
    where = scratch.write(named.select("k", "first", "p1", "p2"))
    distinct = named.groupBy("p1", "p2").agg(F.sum("copies").alias("copies"), F.first("piece").alias("piece"))
    windows = scratch.write(distinct.mapInArrow(_window_batches(length), "w1 long, w2 long, p1 long, p2 long, s int, copies long"))
    often = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1")
    hits = windows.join(often, ["w1", "w2"], "left_semi").groupBy("p1", "p2").agg(F.sort_array(F.collect_set("s")).alias("at"))
    # neighbouring windows as one run
    starts = F.filter("at", lambda x, i: F.coalesce(F.get("at", i - 1) < x - 1, F.lit(True)))
    ends = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) > x + 1, F.lit(True)))
    runs = scratch.write(hits.select("p1", "p2", F.arrays_zip(starts.alias("a"), ends.alias("z")).alias("runs")))
    found = where.join(runs, ["p1", "p2"]).select("k", "first", F.explode("runs").alias("r"))
    return found.select("k", (F.col("first") + F.col("r.a")).alias("start"), (F.col("first") + F.col("r.z") + length).alias("stop"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, starts, stops (of removed runs), kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the
    table, in the same text or another; occurrences may overlap, and all are judged on the input.
    Null text is empty. Rows that repeat a text, whatever their ids, are copies of one another.
    Texts below 2 GiB. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    slim = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    slim = _keyed(slim, scratch)
    # texts stay where they are: later joins on k bring only the small side
    name = f"repeats_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        slim.groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("copies")).write.option("compression", "zstd").bucketBy(parts, "k").saveAsTable(name)
        texts = spark.table(name)
        spots = scratch.write(texts.select("k", "text").mapInArrow(_anchor_batches(length, gram), "k long, anchor long, first int, last int, place int, until int"))
        often = scratch.write(spots.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
        own = spots.where("until > last").select("k", F.col("first").alias("start"), (F.col("until") + length).alias("stop"))

        def pieces(some: DataFrame) -> DataFrame:
            near = spots.join(some, "anchor", "left_semi")
            spots_of = near.groupBy("k").agg(F.collect_list(F.struct("anchor", "first", "last", "place", "until")).alias("spots"))
            cut = texts.join(spots_of, "k").select("k", "text", "copies", "spots")
            return cut.mapInArrow(_cut_batches(length), "k long, first int, anchor long, before int, copies long, piece binary")

        dealt = pieces(often.where(F.col("n") <= CROWD)).repartition("anchor").sortWithinPartitions("anchor")
        runs = dealt.mapInArrow(_sort_batches(length), "k long, start int, stop int").unionByName(own)
        crowded = often.where(F.col("n") > CROWD)
        if not crowded.isEmpty():
            runs = runs.unionByName(_crowded_runs(pieces(crowded), length, scratch))
        runs = scratch.write(runs.groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("runs")))
        scratch.drop(spots)
        schema = "k long, n_bytes long, n_removed long, starts array<int>, stops array<int>, kept_sha256 string"
        clean = texts.join(runs, "k", "left").select("k", "text", "copies", "runs").mapInArrow(_clean_batches(length), schema)
        clean = scratch.write(clean)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return slim.select("id", "k").join(clean, "k").select(F.col("id").alias(doc_id), "n_bytes", "n_removed", "starts", "stops", "kept_sha256")
