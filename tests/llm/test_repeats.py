import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from driftloom.llm import repeats


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def got(df, **more):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256)) for r in repeats.remove_repeats(df, **more).collect())


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 100).astype(np.uint64)
    for w in (1, 7, 100):
        assert repeats.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(101 - w)]


@pytest.mark.parametrize(("length", "gram", "block", "crowd"), [(20, 6, 8192, 1 << 16), (30, 30, 5, 1 << 16), (12, 3, 1, 4), (20, 6, 8192, 1)])
def test_random(spark, monkeypatch, length, gram, block, crowd):
    """In small blocks, and with some or all anchors crowded."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    r = random.Random(length)
    make = lambda n, letters="abcdé ": "".join(r.choice(letters) for _ in range(n))
    shared = [make(n) for n in (length - 3, length // 2, length, length + 1, 70, 300)]
    rows = []
    for i in range(60):
        t = "".join(r.choice((make(r.randint(0, 60)), r.choice(shared))) for _ in range(r.randint(0, 5)))
        rows.append((i, t))
    rows += [(100, "a" * 400), (101, "ab" * 90), (102, None), (103, ""), (None, shared[5]), (5, rows[5][1]), (104, make(2000)), (105, make(900) * 2)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, k int, copies int")
    assert got(df, length=length, gram=gram) == brute(rows, length)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 200)


def test_periodic_stretches_are_one_piece():
    for unit in (b"a", b"ab", b"abcde" * 3, bytes(range(100))):  # up to as many bytes as a window has grams
        body = np.frombuffer(b"start of it" + unit * (1_000_000 // len(unit)) + b"the end", np.uint8)
        row, anchor, first, last, place, until = repeats.anchors(body, np.array([0, len(body)]), 200, 64)
        assert len(row) < 1000
        # pieces and their runs cover every window once
        assert first[0] == 0 and until[-1] == len(body) - 200 and (first[1:] == until[:-1] + 1).all()


def test_many_texts_with_one_passage(spark):
    """A third of all windows share their anchors; no block holds them all."""
    passage = " ".join(f"licence{i}" for i in range(60))
    rows = [(i, f"{i} " * 40 + passage + f" {i * 7}" * 40) for i in range(400)] + [(1000, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    repeats_crowd, repeats.CROWD = repeats.CROWD, 100
    try:
        found = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    finally:
        repeats.CROWD = repeats_crowd
    assert found[1000].n_removed == 1_000_000 and len(found[1000].starts) == 1
    want = {eval(x)[0]: eval(x) for x in brute(rows[:-1], 200)}
    assert all((r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) == want[i][1:] for i, r in found.items() if i < 1000)


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
