import random
from collections import defaultdict

import numpy as np
import pytest

from driftloom.llm import minhash
from driftloom.llm.components import connected_components
from driftloom.llm.shared import Scratch

SPACE = " \t\n\x0b\x0c\r"


def fold(text):
    return text.encode().lower().split()


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = fold(text or "")
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for j, s in enumerate(sets):
        for x in s:
            index[x].append(j)
    shared = defaultdict(int)
    for at in index.values():
        for i in range(len(at)):
            for j in range(i):
                shared[at[j], at[i]] += 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((root(rows[i][0]), root(rows[j][0])))
            parent[b] = a
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


def texts(seed, bases=6, copies=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for b in range(bases):
        base = [r.choice(vocab) for _ in range(r.choice((3, 12, 40, 120)))]
        for c in range(copies):
            t = list(base)
            for _ in range(int(len(t) * r.choice((0, 0, 0.02, 0.04, 0.08)))):
                t[r.randrange(len(t))] = r.choice(vocab)
            if c % 3 == 0:
                t = [x.upper() for x in t]
            out.append(" ".join(t))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (2, 5)])
def test_same_as_brute_force(spark, seed, k):
    rows = list(enumerate([*texts(seed), "", None, " \n", "one", "One", "É", "é", "a b", "a  b"]))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=k).collect()
    want = brute(rows, k, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(docs, shingle_words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_odd_rows(spark):
    schema = "doc_id long, text string, n long, class string, bands string"
    rows = [(3, "a b c d e f", 1, "x", ""), (3, "a b c d e f", 1, "x", ""), (None, "a b c d e f", 2, None, None)]
    rows += [(None, None, 0, "", ""), (5, "z" * 300_000, 0, "", ""), (None, "only here once more today", 0, "", "")]
    got = sorted(
        tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, schema)).fillna(-1).collect()
    )
    assert got == [(-1, 0, -1, False), (-1, 1, -1, False), (-1, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (5, 1, 5, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    a = r.integers(1, 1 << 62, 900).astype(np.uint64)
    b = np.concatenate([a[:700], r.integers(1, 1 << 62, 200).astype(np.uint64)])
    s = minhash.sketches([a, b, a[:3]], 4096)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 700 / 1100) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y", Scratch(spark, "t")).collect()
    assert dict(tuple(r) for r in got) == {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 250)]}
