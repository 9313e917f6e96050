import random
import re

from pyspark.sql import functions as F

from driftloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, text in items:
        w = words(text)
        k = min(len(w), window)
        for j in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, named = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    hit |= set(range(j, j + k))
                    named |= wins[tuple(w[j : j + k])]
        out.append((d, len(w), len(hit), sorted(str(i) for i in named if i is not None), hit))
    return sorted(out, key=repr)


def held(spark, docs, items, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("row"), F.lit(2).alias("norm"), F.lit(3).alias("items")).repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(0))
    rows = decontaminate.contamination(df, bench, **kw).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, list(r.items), {p for a, z in r.spans for p in range(a, z)}) for r in rows]
    assert all(a < z and (i == 0 or r.spans[i - 1].after < a) for r in rows for i, (a, z) in enumerate(r.spans))
    assert sorted(got, key=repr) == brute(docs, items, kw.get("window", 10))


def test_as_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["Aa", "b-c", "É", "é", "Σς", "d9", "x_y", "K", "the"]) for _ in range(n))
    long = text(60)
    items = [(i, text(rng.randint(1, 30))) for i in range(20)] + [(30, long), (31, long), (31, long), (None, text(14)), (32, None), (33, "..."), (34, "Aa"), (35, "b c é")]
    docs = [(i, f"{text(rng.randint(0, 40))} {rng.choice(items)[1] or ''} {text(rng.randint(0, 10))}") for i in range(60)]
    docs += [(3, docs[3][1]), (4, "other"), (None, long), (None, None), (70, ""), (71, long.upper()), (72, long.replace(" ", "\n--\t")), (73, " ".join(long.split()[:9])), (74, f"{long} {long}")]
    held(spark, docs, items)
    held(spark, docs, items, window=4)


def test_only_windows_of_a_common_passage(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(i, f"a{i} {passage} z{i}") for i in range(2000)] + [(5000, passage.replace("w5", "v5"))]
    held(spark, docs, [(1, passage), (2, f"q {passage}"), (3, "w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")])


def test_shuffled_sides(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    held(spark, [(1, "a b c d e f g h i j k l"), (2, "no"), (3, None)], [(1, "b c d e f g h i j k"), (2, "no")])


def test_empty_tables(spark):
    held(spark, [(1, "a b"), (2, None)], [])
    held(spark, [], [(1, "a b")])
    held(spark, [(1, "a b")], [(1, None), (2, "")])
