import random

import pytest
from pyspark.sql import functions as F

from driftloom.llm import line_dedup
from driftloom.llm.shared import Scratch


def brute(rows, percent=80):
    """Rows with one id come in the order of a hash of their texts, which only Spark knows; so ids that clash are left to their own test."""
    cells = [(i, n, line.lower().split()) for i, text in rows if i is not None and text is not None for n, line in enumerate(text.split("\n"))]
    cells = sorted({(i, n, frozenset(w)) for i, n, w in cells if w}, key=lambda c: c[:2])
    gone, seen = set(), []
    for i, n, s in cells:
        if any(100 * len(s & t) >= percent * len(s | t) for t in seen):
            gone.add((i, n))
        seen.append(s)
    out = []
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        stay = [x for n, x in enumerate(lines) if (i, n) not in gone]
        out.append((i, None if text is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(map(str, out))


def lines_like_each_other(seed, every=""):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(3000)]
    bases = [[r.choice(vocab) for _ in range(r.choice((1, 2, 3, 4, 5, 6, 9, 15, 40, 150)))] for _ in range(40)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(r.randint(1, 8)):
            line = list(r.choice(bases))
            for _ in range(int(len(line) * r.choice((0, 0, 0.05, 0.1, 0.2)))):
                line[r.randrange(len(line))] = r.choice(vocab)
            line = (" " * r.randint(1, 2)).join(line).upper() if r.random() < 0.3 else " ".join(line)
            lines.append(f"{every} {line}" if every else line)
        rows.append((i, "\n".join(lines)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "w") for x in rows], "doc_id long, text string, no int, line string")


def same(spark, rows):
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted(str(tuple(x)) for x in got) == brute(rows)


def test_random(spark):
    rows = lines_like_each_other(2)
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, rows[0][1]), (203, "long " + "x" * 100_000), (5, rows[5][1]), (204, "a\tb\r"), (205, "B  a"), (206, "}\n}\n{"), (207, "}")]
    same(spark, rows)


@pytest.mark.parametrize("every", ["", "the", "the of"])
def test_hot_words_and_shuffled_sides(spark, every, monkeypatch):
    """A word in every line makes no group: hot words are posted in pairs. No side is broadcast."""
    monkeypatch.setattr(line_dedup, "HOT_COUNT", 8)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(line_dedup, "BUCKETS", (1 << 14, 1 << 14))
    same(spark, lines_like_each_other(3, every))


@pytest.mark.parametrize("hot", [8, 4096])
@pytest.mark.parametrize("broadcast", [-1, 1 << 20])
def test_crowds(spark, hot, broadcast, monkeypatch):
    """Near copies of a word's first line leave before its lines form pairs; lines like a line that left still go."""
    for k, v in {"CROWD": 3, "HOT_COUNT": hot, "BROADCAST_BYTES": broadcast, "BUCKETS": (1 << 14, 1 << 14)}.items():
        monkeypatch.setattr(line_dedup, k, v)
    same(spark, lines_like_each_other(5, "the"))


def test_text_is_split_once(spark):
    """Words are counted, ordered and compared by hashes that one pass over the texts has written."""
    reads = spark.sparkContext.accumulator(0)

    def read(text):
        reads.add(1)
        return text

    rows = lines_like_each_other(6)
    texts = frame(spark, rows).select(F.shiftleft("doc_id", 12).alias("base"), F.udf(read)("text").alias("text"))
    found = line_dedup.matched_lines(texts, 12, 1 << 20, 80, Scratch(spark, "split-once"))
    assert found.count() == sum(int(x.rsplit(" ", 1)[1][:-1]) for x in brute(rows))
    assert reads.value == len(rows)


def test_rows_that_share_an_id(spark):
    once, twice = "only here stands this line of words", "this other one is found in two places"
    rows = [(1, twice), (2, once), (2, f"{twice}\nmore of it"), (2, f"{twice}\nmore of it")]
    got = sorted((r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted([(twice, 0), (once, 0), ("more of it", 1), ("more of it", 1)])


def test_rows_keep_their_columns(spark):
    rows = [(1, "a b c", "x"), (2, "a b c", "y"), (3, "a b c\nd e f", "z"), (None, "a b c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `gone.lines` string")
    got = sorted(map(tuple, line_dedup.without_repeated_lines(df).collect()), key=str)
    assert got == [(1, "a b c", "x"), (3, "d e f", "z"), (None, "a b c", None)]


def test_ids_that_are_no_numbers(spark):
    rows = lines_like_each_other(4)
    df = spark.createDataFrame([(f"d{i:04}", text) for i, text in rows], "doc_id string, text string")
    got = [(int(r[0][1:]), *r[1:]) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(map(str, got)) == brute(rows)


def test_copies_are_found_without_the_text(spark, monkeypatch):
    """Copies come from the lines' hashes, which are written once: the text is not split and hashed again for them."""
    seen, join = {}, line_dedup._join
    monkeypatch.setattr(line_dedup, "_join", lambda big, few, on, how, n: (seen.setdefault(how, big.columns), join(big, few, on, how, n))[1])
    same(spark, [(1, "a b\nC d"), (2, "A b\n\tc\x0bd\n\x0b\r"), (3, "Σας ΣΑΣ\r\nσας ΣΑΣ"), (4, "σας σας\nİ i")])
    assert seen["left_semi"] == ["c", "k1", "k2"]


def test_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
