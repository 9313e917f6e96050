"""Importance resampling towards a target distribution, over a stored sparse matrix.

Texts become rows of counts over hashed buckets of word runs (one to three words). The matrix is
written once, as blocks in compressed sparse row form: ids, row ends, buckets and counts. Its column
sums, summed by task before the shuffle, are the distribution of the corpus; those of the target's
matrix are the target's. A bucket's gain compares the two, and a product of the sparse blocks with
the vector of gains gives each document its weight. Documents are then drawn without replacement by
weight plus Gumbel noise from a hash of seed and id, so that runs repeat on any partitioning.

The vector is as long as there are buckets. Ranks come from ranges of the score and their sizes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from driftloom.llm.shared import Scratch, slices

BUCKETS, RUN, SEED, LEAST_WORDS = 10_000, 3, 42, 20
#: A block's entries, and the bytes of text that are turned into words at once.
BLOCK_ENTRIES, STRETCH = 1 << 18, 1 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _stretches(body: bytes) -> Iterator[bytes]:
    """Pieces of about ``STRETCH`` bytes of lower-cased text, which end where a word ends."""
    a = 0
    while len(body) - a > STRETCH:
        gap = _BREAK.search(body, a + STRETCH)
        if gap is None:
            break
        yield body[a : gap.end()]
        a = gap.end()
    yield body[a:]


def bucket_counts(body: bytes, buckets: int, run: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, and the buckets of their runs with the counts.

    The checksum of a run continues that of the run without its last word.
    """
    n, tail, parts = 0, [], []
    for piece in _stretches(body.lower()):
        words = _WORD.findall(piece)
        if not words:
            continue
        both, old = tail + words, len(tail)
        after = [b" " + w for w in both]
        sums = list(map(crc32, both))
        seen = [np.array(sums[old:], np.int64)]
        for k in range(1, run):  # sums[i] is that of the k words from i on; new are those that end behind the tail
            sums = list(map(crc32, after[k:], sums))
            seen.append(np.array(sums[max(0, old - k) :], np.int64))
        n += len(words)
        tail = both[len(both) - min(run - 1, len(both)) :]
        at, counts = np.unique(np.concatenate(seen) % buckets, return_counts=True)
        parts.append((at, counts))
    if not parts:
        return n, np.empty(0, np.int64), np.empty(0, np.int64)
    if len(parts) == 1:
        return n, *parts[0]
    total = np.zeros(buckets, np.int64)
    for at, counts in parts:
        total[at] += counts
    at = np.flatnonzero(total)
    return n, at, total[at]


def _packed(cells: np.ndarray) -> bytes:
    return pa.compress(cells.tobytes(), codec="zstd", asbytes=True)


def _cells(block: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ends, buckets and counts of a batch of one block."""
    ends = block.column("ends").flatten().to_numpy(zero_copy_only=False)
    kinds = {"buckets": np.min_scalar_type(buckets - 1), "counts": np.dtype(np.int32)}
    unpacked = (pa.decompress(block.column(c)[0].as_buffer(), int(ends[-1]) * kind.itemsize, codec="zstd", asbytes=True) for c, kind in kinds.items())
    return ends, *(np.frombuffer(x, kind) for x, kind in zip(unpacked, kinds.values(), strict=True))


def matrix(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Blocks (ids, words, ends, buckets, counts) of the rows (id, text).

    ``buckets`` and ``counts`` are compressed arrays of all entries of the block, row after row;
    ``ends`` says where rows end in them. A reader thus holds packed blocks and unpacks one at a time.
    """
    small = np.min_scalar_type(buckets - 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                first, words, ends, at, counts, entries = 0, [], [], [], [], 0

                def block(upto: int):
                    ids = part.column(0).slice(first, upto - first)
                    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, counts)]
                    lists = [pa.array(np.asarray(words, np.int64)), pa.array(np.asarray(ends, np.int32))]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, *lists)]
                    packed = [pa.array([_packed(c.astype(kind))], pa.binary()) for c, kind in zip(flat, (small, np.int32), strict=True)]
                    return pa.RecordBatch.from_arrays([*lists, *packed], ["ids", "words", "ends", "buckets", "counts"])

                for i, text in enumerate(part.column(1)):
                    body = (text.as_py() or "").encode()
                    n, b, c = bucket_counts(body, buckets, run)
                    entries += len(b)
                    words.append(n), ends.append(entries), at.append(b), counts.append(c)
                    if entries >= BLOCK_ENTRIES:
                        yield block(i + 1)
                        first, words, ends, at, counts, entries = i + 1, [], [], [], [], 0
                if words:
                    yield block(part.num_rows)

    cells = {"ids": texts.schema["id"].dataType, "words": LongType(), "ends": IntegerType()}
    lists = [StructField(c, ArrayType(kind)) for c, kind in cells.items()]
    return texts.mapInArrow(task, StructType([*lists, *(StructField(c, BinaryType()) for c in ("buckets", "counts"))]))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Sums of the matrix's columns; each task sends the sums of its blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, at, counts = _cells(batch.slice(i, 1), buckets)
                total += np.bincount(at, counts, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    sums = blocks.select("ends", "buckets", "counts").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(buckets, np.int64)
    total[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: 1000 times the logarithm of target over corpus, one added to each count, rounded down."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def products(blocks: DataFrame, vector: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of the matrix: sums of counts and of counts times ``vector``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ends, at, counts = _cells(one, len(vector))
                ends, counts = np.concatenate(([0], ends)), counts.astype(np.int64)
                by_row = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (counts, counts * vector[at])]
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("words").flatten(), *map(pa.array, by_row)], ["id", "n_words", "n_features", "weight"])

    cells = {"id": blocks.schema["ids"].dataType.elementType, **dict.fromkeys(("n_words", "n_features", "weight"), LongType())}
    return blocks.mapInArrow(task, StructType([StructField(c, kind) for c, kind in cells.items()]))


def importance(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """One row per input row: id, n_words, n_features, weight, score, rank (null if not drawn).

    Of the rows with ``least_words`` words or more, ``percent`` of a hundred (rounded down) with the
    highest scores are drawn; ties go to the smaller id, then to fewer features. Null and empty
    texts have no features and weigh nothing. A null id is hashed as an empty one and comes first
    among ties. Repeated rows are scored alike, and each may be drawn. Without target texts every
    gain compares with a flat distribution; without documents there are no rows.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    blocks = scratch.write(matrix(docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")), buckets, run))
    aims = scratch.write(matrix(target.select(F.lit(0).alias("id"), F.col(target_text).cast("string").alias("text")), buckets, run))
    weighed = products(blocks, gains(column_sums(blocks, buckets), column_sums(aims, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("fit"))
    # the last of these sets equal rows apart, so that a range never has to hold them all
    scored = scratch.write(scored.withColumn("salt", F.monotonically_increasing_id()))
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_first("id"), F.asc("n_features"), F.asc("salt")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = scratch.write(dealt.drop("salt").withColumn("row", F.monotonically_increasing_id()))
    # a row's range is above bit 33: one row for each range in the window
    ranges = dealt.groupBy(F.shiftright("row", 33).alias("range")).agg(F.count("*").alias("size"), F.sum(F.col("fit").cast("long")).alias("fits"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = scratch.write(ranges.select("range", "fits", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip")))
    drawn = (ranges.agg(F.sum("fits")).first()[0] or 0) * percent // 100
    place = F.col("skip") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    both = dealt.join(ranges, F.shiftright("row", 33) == F.col("range"))
    return both.select(F.col("id").alias(doc_id), "n_words", "n_features", "weight", "score", F.when(place <= drawn, place).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs``, with their columns, whose id was drawn; rows without an id are left out."""
    drawn = importance(docs, target, doc_id, text, **parameters).where("rank is not null")
    return docs.join(drawn.select(F.col(doc_id).alias("_drawn_id")).distinct(), F.col(doc_id) == F.col("_drawn_id"), "left_semi")
