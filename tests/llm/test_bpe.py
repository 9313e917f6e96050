import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RAW = bpe.read_ranks(PATH)
RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RAW.splitlines())}
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RAW, P.PATTERN)


def same(text):
    ids = CODEC.encode(text)
    assert list(ids) == REAL.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("aehnot '\n\té1.#", max_size=300), st.text("ab", max_size=200)))
def test_as_tiktoken(text):
    same(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n  x", "a" * 5000, "ab" * 3000, "the" * 2000 + "!" * 999, "word " * 40_000, "é" * 70_000, " \n" * 50_000, "<|endoftext|>"],
)
def test_long_pieces(text):
    same(text)


def test_join_is_associative():
    data = "internationalisation unbelievably thththonthe".encode() * 3
    parts = [data[i : i + 7] for i in range(0, len(data), 7)]
    left = right = ()
    for p in parts:
        left = CODEC.join(left, CODEC.merged[p])
    for p in reversed(parts):
        right = CODEC.join(CODEC.merged[p], right)
    assert left == right == CODEC.merge(data) == bpe.merge_long(data, RANKS)


@pytest.mark.parametrize("unit", [b"a", b"the", b"ab", "é".encode(), b"aab", b"0"])
def test_windows_longer_than_the_limit(unit):
    """Windows that keep growing are merged directly, with the same ids."""
    data = unit * (9 * bpe.LONG_WINDOW // len(unit) + 1)
    assert bpe.Codec(RAW, P.PATTERN)._halves(data) == bpe.merge_long(data, RANKS)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.characters(max_codepoint=127)), st.text("aB'slr 1\n\t\x0b\x1c\x1f\x85.#", max_size=60)))
def test_ascii_texts_are_split_alike(text):
    """ASCII texts go to the faster engine, with the same matches."""
    assert CODEC.split_ascii is not None
    assert CODEC.split(text) == CODEC.split_any(text)


def test_other_patterns_keep_their_engine():
    for pattern in (r"\w+", r"(?i:'s)|\p{L}+", r"\p{Lu}+", "a.b", "^a", r"[\S]", r"(?i)a"):
        assert bpe._for_ascii(pattern) is None
    assert bpe._for_ascii(r"\p{N}{1,3}|[^\s]+")("12345 a") == ["123", "45", "a"]


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [*(tuple(r) for r in docs.select("doc_id", "text").collect()), (7, None), (None, "x"), (7, "")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, key int, ids string")
    out = bpe.digests(bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)).collect()
    want = []
    for i, text in rows:
        ids = REAL.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
