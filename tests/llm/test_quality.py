import re
from collections import Counter
from math import log2, sqrt

import pytest

from driftloom.llm import quality


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, counted plainly."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(runs)
    hit = {i + j for i, r in enumerate(runs) if often[r] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def distance(p, q):
    if not sum(p):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: a * log2(2 * a / (a + b)) if a else 0.0
    return sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q, strict=True)) / 2))


def histogram(text):
    text = text or ""
    named = [r"[\x20\x09-\x0D]", quality.SYMBOLS, *quality.CLASSES.values()]
    counts = [len(re.findall(x, text)) for x in named]
    return [*counts, len(text) - sum(counts)]


PROSE = "The quick brown fox jumps over the lazy dog and runs to the river that is near it, as was told by them. "
ROWS = [
    (1, PROSE * 1 + "One more sentence follows.", "en"), (2, None, "en"), (3, "", "en"), (4, " \t\n\x0b ", "en"), (5, "nine words are too few for it to stay", "en"),
    (6, "ten words are enough for it to stay in here", "en"), (7, PROSE * 3, "en"), (8, "a line\na line\n\n\nb\x0b\na line\r", "en"),
    (9, "#$%&|<> *** " * 30, "en"), (10, "0123 4567 89 " * 12 + "1 22 333 4444 5 66 777 8888 9 10 11 12 13", None), (11, "un mot de la fin et les autres qui est pour une fois dans le texte que voici", "xx"),
    (12, "x" * 300_000 + " y", "de"), (None, PROSE, "en"), (1, PROSE * 1 + "One more sentence follows.", "en"),
    (13, "w1 w2 w3 w4 w5 " + " ".join(f"v{i}" for i in range(35)) + " w1 w2 w3 w4 w5", "en"),  # 10 of 45 words: above a fifth
    (14, "w1 w2 w3 w4 w5 " + " ".join(f"v{i}" for i in range(40)) + " w1 w2 w3 w4 w5", "en"),  # 10 of 50: a fifth exactly
]


@pytest.fixture(scope="module")
def judged(spark):
    least, quality.LEAST_DOCUMENTS = quality.LEAST_DOCUMENTS, 5
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, lang string, q_words int, `q.list` string")
    yield df, quality.assess(df).collect()
    quality.LEAST_DOCUMENTS = least


def test_base_counts(judged):
    _, got = judged
    want = sorted(str((i, *base(t))) for i, t, _ in ROWS)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_character_distance(judged):
    _, got = judged
    lang = lambda x: x if x == "en" else "other"  # noqa: E731 (the only one with enough documents)
    whole = {}
    for _, t, x in ROWS:
        whole[lang(x)] = [a + b for a, b in zip(whole.get(lang(x), [0] * 7), histogram(t), strict=True)]
    want = sorted((i or 0, round(distance(histogram(t), whole[lang(x)]), 9)) for i, t, x in ROWS)
    assert sorted((r.doc_id or 0, round(r.character_distance, 9)) for r in got) == want
    for r in got:
        far = r.n_words >= quality.LEAST_WORDS["characters"] and r.character_distance > quality.MOST_DISTANCE["characters"]
        far |= r.n_words >= quality.LEAST_WORDS["words"] and r.word_distance > quality.MOST_DISTANCE["words"]
        assert r.kept == (not r.base_failed and not far)


def test_common_words(judged):
    df, _ = judged
    c = Counter(w for _, t, x in ROWS if x == "en" for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    assert quality.common_words(df, "text", "lang") == {"en": sorted(c, key=lambda w: (-c[w], w))[: quality.COMMON]}


def test_keep_agrees_with_assess(judged):
    df, got = judged
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.assess(df).count() == 0 and quality.keep(df).count() == 0
