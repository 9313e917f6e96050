"""Byte-level BPE as a monoid: encodings of neighbouring byte strings are joined up a binary tree.

An encoding is *valid* if merging its bytes gives it back. Two facts carry the join:

* A token sequence is valid if and only if each adjacent pair of tokens, merged alone, gives that
  pair. (Merges go by lowest rank, leftmost first. Up to the first merge that would cross a token
  boundary, the merges inside any two neighbours are the ones they would make alone, and so that
  crossing merge would also happen in the pair alone.)
* Joining valid A and B therefore only needs a window around the seam: re-encode the last i tokens
  of A with the first j of B. If the result starts with the same token as the window did, the pair
  before it is one of A's own and stays valid, and likewise at the end with B. All pairs are then
  valid, so the whole is. Otherwise that side of the window doubles.

Halves of a piece are encoded recursively down to a few bytes. Texts are pieces of the split
pattern, between which nothing merges; long texts are halved where white space follows something
else, at which the pattern always starts a piece. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.shared import slices

#: Bytes that are merged directly, characters and tokens at which the trees over texts end.
LEAF_BYTES, LEAF_CHARS, LEAF_TOKENS = 12, 1 << 16, 1 << 16
#: Bytes from which a window that still grows is merged directly instead of up a tree of its own.
LONG_WINDOW = 1024
#: Entries of each cache of a worker, and the longest that is kept; it empties when full, so memory stays bounded.
CACHED, CACHED_LENGTH = 120_000, 64
_NONE = 1 << 62


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read where the driver runs; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


class _Cache(dict):
    """Computes missing entries; keeps at most two generations of ``CACHED`` entries."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) > CACHED_LENGTH:
            return value
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.split_any, self.split_ascii = regex.compile(pattern).findall, _for_ascii(pattern)
        self.pieces = _Cache(self._piece)
        self.merged = _Cache(self._halves)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        return self.split_ascii(text) if self.split_ascii and text.isascii() else self.split_any(text)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        return self.merge(data) if len(data) <= LEAF_BYTES else self._halves(data)

    def _halves(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.merged[data[:half]], self.merged[data[half:]])

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost among equals."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [rank(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while found and (low := min(found)) != _NONE:
            at = found.index(low)
            parts[at] += parts.pop(at + 1)
            del found[at]
            if at < len(found):
                found[at] = rank(parts[at] + parts[at + 1], _NONE)
            if at:
                found[at - 1] = rank(parts[at - 1] + parts[at], _NONE)
        return tuple(map(self.ranks.__getitem__, parts))

    def window(self, tokens: Sequence[int]) -> tuple[int, ...]:
        """The valid encoding of a window's bytes."""
        data = b"".join(map(self.bytes_of.__getitem__, tokens))
        if len(data) > LONG_WINDOW:
            return merge_long(data, self.ranks)
        return self.merge(data) if len(data) <= 16 else self.merged[data]

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The valid encoding of two valid encodings' bytes."""
        if not a or not b:
            return a or b
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            tokens = a[-i:] + b[:j]
            if i == len(a) and j == len(b):  # nothing is outside
                return self._seam(tokens)
            new = self.window(tokens)
            left, right = i == len(a) or new[0] == a[-i], j == len(b) or new[-1] == b[j - 1]
            if left and right:
                return a[:-i] + new + b[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def _seam(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """A window that has grown over everything, merged directly."""
        data = b"".join(map(self.bytes_of.__getitem__, tokens))
        return merge_long(data, self.ranks) if len(data) > 64 else self.merge(data)

    def encode(self, text: str) -> array.array:
        """Ids of a whole text."""
        if len(text) > LEAF_CHARS and (cut := _safe_cut(text)):
            left = self.encode(text[:cut])
            left.extend(self.encode(text[cut:]))
            return left
        return array.array("i", chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: Sequence[int]) -> bytes:
        if len(ids) > LEAF_TOKENS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: What classes hold of ASCII, inside of brackets.
_ASCII = {r"\p{L}": "a-zA-Z", r"\p{N}": "0-9", r"\s": r"\t-\r\x20"}


def _for_ascii(pattern: str):
    """``findall`` of the same pattern for ASCII texts in Python's own engine, which is faster; None if it uses more than the classes above."""
    inside = False
    out, at = [], 0
    while at < len(pattern):
        known = next((x for x in (*_ASCII, r"\S") if pattern.startswith(x, at)), None)
        if known == r"\S" and not inside:
            out.append(f"[^{_ASCII[chr(92) + 's']}]")
        elif known and known != r"\S":
            out.append(_ASCII[known] if inside else f"[{_ASCII[known]}]")
        elif known or pattern[at] in "\\.^$" and not (inside and pattern[at - 1 : at + 1] == "[^") or pattern[at : at + 2] == "(?" and pattern[at : at + 3] not in ("(?!", "(?="):
            return None
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
        at += len(known or " ")
    return re.compile("".join(out)).findall


def _safe_cut(text: str) -> int:
    """Near the middle, a place where white space follows something else; 0 if there is none."""
    found = regex.compile(r"\S(?=\s)").search(text, len(text) // 2)
    if not found or found.end() >= len(text):
        found = regex.compile(r"(?r)\S(?=\s)").search(text, 0, len(text) // 2)
    return found.end() if found else 0


def merge_long(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The merge order of :meth:`Codec.merge` with a heap over a linked list: n log n."""
    import heapq

    n = len(data)
    end = list(range(1, n + 1))  # a part starts at i and ends at end[i]; 0: merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(data[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(data[k:stop])) is not None:
            heapq.heappush(heap, (r, k, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return tuple(out)


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One for each worker process, with its caches, however many tasks it runs."""
    key = hash(ranks), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _flat(arrays: list[array.array]) -> tuple[pa.Array, pa.Array]:
    at = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    body = np.concatenate([np.frombuffer(x, np.int32) for x in arrays if len(x)] or [np.zeros(0, np.int32)])
    return pa.array(at), pa.array(body)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for each row: the ids of the whole text, each match of ``pattern`` by itself.

    No special tokens: their strings are ordinary text. Null or empty text: no ids. Rows are
    independent, so repeated rows and null keys come out as they went in.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for whole in batches:
            for batch in slices(whole, 1):
                ids = [c.encode(x or "") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(*_flat(ids))], ["key", "ids"])

    slim = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(work, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): the bytes of each row's ids. Null ids: no bytes. An unknown id is an error."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            column = batch.column(1)
            at, body = np.asarray(column.offsets), np.asarray(column.values)
            out = [c.decode(body[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(out, pa.binary())], ["key", "ids", "decoded"])

    slim = df.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(work, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 of the result of :func:`decode`."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
