import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    f = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), Counter(zlib.crc32(x.encode()) % 10000 for x in f)


def brute(docs, target, percent=5, least=20):
    s, t, of = Counter(), Counter(), [runs(text) for _, text in docs]
    for _, c in of:
        s.update(c)
    for text in target:
        t.update(runs(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for (i, _), (n, c) in zip(docs, of, strict=True):
        w = sum(k * gain(b) for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, sum(c.values()), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], -1 if x[0] is None else x[0], x[2]))
    drawn = fit[: len(fit) * percent // 100]
    ranked = [(*x, k + 1) for k, x in enumerate(drawn)]
    return sorted(map(repr, ranked + [(*x, None) for x in out if not any(x is d for d in drawn)]))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Ab", "cd", "É9", "ef-gh", "x_1", "日本"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(300)]
    return rows + [(7, rows[7][1]), (8, "one more"), (None, text(30)), (None, text(40)), (301, None), (302, ""), (303, "-- ,")]


def test_as_brute_force(spark, docs):
    target = ["Ab cd ab cd", None, "日本 É9"]
    clash = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("ids"), F.lit(2).alias("score"), F.lit(3).alias("rank")).repartition(5)
    got = importance.importance(clash, spark.createDataFrame([(t,) for t in target], "text string"), percent=30).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(docs, target, 30)


def test_long_texts_in_stretches(monkeypatch):
    rng = random.Random(1)
    body = " ".join(rng.choice(["aa", "Bb", "c", "dddddd"]) + rng.choice(["", ",", "\n"]) for _ in range(500)).encode() + b"z" * 300
    whole = importance.bucket_counts(body, 997, 3)
    monkeypatch.setattr(importance, "STRETCH", 16)
    cut = importance.bucket_counts(body, 997, 3)
    assert whole[0] == cut[0] and (whole[1] == cut[1]).all() and (whole[2] == cut[2]).all()
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(importance, "STRETCH", size)
        _, at, n = importance.bucket_counts(b"a b c a b", 997, 3)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == Counter(zlib.crc32(x) % 997 for x in [b"a", b"b", b"c", b"a", b"b", b"a b", b"b c", b"c a", b"a b", b"a b c", b"b c a", b"c a b"])


def test_blocks(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "id long, text string")
    a = importance.matrix(df).select(F.sum(F.size("ids")), F.sum(F.element_at("ends", -1)), F.expr("bool_and(size(ids) = size(ends) and size(ids) = size(words))")).first()
    assert tuple(a) == (len(docs), sum(len(runs(t)[1]) for _, t in docs), True)
    sums = importance.column_sums(importance.matrix(df))
    total = Counter()
    for _, t in docs:
        total.update(runs(t)[1])
    assert {b: n for b, n in enumerate(sums.tolist()) if n} == total


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in importance.importance(one, none, percent=100).collect()] == [(1, 40, 117)]


def test_resampled_rows(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_extra", F.lit("x"))
    aim = spark.createDataFrame([("Ab cd",)], "text string")
    got = importance.resampled(df, aim, percent=50)
    drawn = {r.doc_id for r in importance.importance(df, aim, percent=50).where("rank is not null").collect()} - {None}
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == drawn and drawn
