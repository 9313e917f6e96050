"""What the operators share: tables in the cluster's shared folder, and words of Arrow text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The word rule of all operators: runs of anything but these bytes.
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is configured: on one machine a temporary folder, on a cluster one in the warehouse.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _OWN[0]


class Scratch:
    """Tables written under the shared folder to cut lineage: a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            for at in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text each; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    run = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(run, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return body, at - at[0]


def _bytes_to(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_IS_SPACE = _bytes_to(SPACE_BYTES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x2545F4914F6CDD1D)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 64), _BASE))), dtype=np.uint64)
    return _POWERS


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    space = _IS_SPACE[body]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before[at[:-1][at[:-1] < len(body)]] = True
    after[at[1:][at[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    codes = _BYTE_CODE[_LOWER[body[inside + np.repeat(starts, sizes)]]]
    codes *= _powers(int(sizes.max()))[inside]
    return mix(np.add.reduceat(codes, first) + sizes.astype(np.uint64))


def shingle_sets(body: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of k-word runs; with fewer words, of the whole run; without words, none."""
    starts, ends, first = words(body, at)
    h = word_hashes(body, starts, ends)
    runs = h.copy()
    for j in range(1, k):
        runs[: len(h) - j] = mix(runs[: len(h) - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            one = h[a : a + 1].copy()
            for j in range(1, b - a):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + h[a + j])
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
