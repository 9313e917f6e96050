import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from driftloom.llm import infill


def brute(i, text, seed=7, rate=100):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, len(lines), "plain", None, None, text, text
    if h[3] % 100 < 50:
        return i, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return i, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_as_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice(["a", "é", "日本", "\U0001f600", "\n", "\r\n", " ", "<", "P>", "'", "\x00", "\\"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(1, docs[1][1]), (2, "other\n"), (None, "x\ny\nz"), (500, None), (501, ""), (502, "\n"), (503, "a<P>b"), (504, "<M>"), (505, "l\n" * 200_000), (506, "w" * 3_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("whole"), F.lit(2).alias("id"), F.lit(3).alias("form"), F.lit(4).alias("output")).repartition(3)
    for style in (infill.Style(), infill.Style(rate=40, seed=11)):
        got = infill.restored(infill.infilled(df, style=style), style).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(i, t, style.seed, style.rate)) for i, t in docs)


def test_restored_keeps_other_columns(spark):
    rows = spark.createDataFrame([("<P>a<S>c<M>b", "psm", 1, "x"), (None, "psm", 2, None), ("p", "plain", 3, "y")], "output string, form string, whole int, `a.b` string")
    got = infill.restored(rows)
    assert got.columns == ["output", "form", "whole", "a.b", "restored"]
    assert [r.restored for r in got.orderBy("whole").collect()] == ["abc", None, "p"]


def test_empty_table_and_units(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert infill.restored(infill.infilled(none)).count() == 0
    style = infill.Style(units=r"(?s:.)", prefix="[[p]]", suffix="[[s]]", middle="[[m]]")
    got = infill.restored(infill.infilled(spark.createDataFrame([("k", "a\nb]é")], none.schema), style=style), style).first()
    assert got.n == 5 and got.restored == "a\nb]é" and got.form != "plain" and got.doc_id == "k"


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "<M>"), ("<P>", "<P>", "<M>")])
def test_marks_that_meet(marks):
    with pytest.raises(ValueError):
        infill.Style(prefix=marks[0], suffix=marks[1], middle=marks[2])
