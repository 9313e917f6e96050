import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from test_bpe import REAL
from test_line_dedup import brute as brute_lines
from test_minhash import brute as brute_near

from driftloom.llm import mixing, sql


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_each_stage_on_what_came_before(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(10**7, None, "en", "src1", 0), (None, "a null id has text too, and enough words to be kept by the rules", "en", "src1", 9), (10**7 + 1, "", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    columns = docs.columns
    docs.write.parquet(str(tmp_path / "in"))
    docs = before = spark.read.parquet(str(tmp_path / "in"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        was, now = before.collect(), docs.collect()
        texts = {r.doc_id: r.text for r in was}
        if i < 4:
            assert docs.columns == columns
        if name == "quality rules":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/in/*.parquet')")
            keep = Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({sql.op5()}) WHERE kept").fetchall())
            assert Counter(r.doc_id for r in now) == keep
            assert None in keep
        elif name == "line dedup":
            want = [eval(x) for x in brute_lines([(r.doc_id, r.text) for r in was])]
            assert Counter((r.doc_id, r.text) for r in now) == Counter((w[0], w[1]) for w in want if w[3] == 0 or w[1].strip())
            assert all(r.n_chars == len(r.text) for r in now)
        elif name == "near dedup":
            near = brute_near([(r.doc_id, r.text) for r in was if r.doc_id is not None], 5, 80)
            assert sorted((r.doc_id for r in now), key=str) == sorted([*(i for i, (_, c) in near.items() if i == c), *(r.doc_id for r in was if r.doc_id is None)], key=str)
        elif name == "mix sources":
            size = lambda r: len((r.text or "").encode().split())
            taken = defaultdict(int)
            for r in now:
                taken[r.source] += size(r)
            goal = {r.source: r.target for r in mixing.mix(before).select("source", "target").distinct().collect()}
            assert all(abs(taken[s] - goal[s]) < 200 for s in goal)
            assert max(Counter(r.doc_id for r in now).values()) <= 2
        else:
            assert len(now) == len(was)
            for r in now:
                assert r.ids == REAL.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
                assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "id", "mix_id", "mix_copies", "mix_copy", "named_text", "odd_id", "lost_id", "q_text", "q_lang", "q_row", "dedup_id", "lines", "stays", "ids", "n", "a.b"]


def through(spark, docs):
    """All stages in memory: rows before each, and what comes out at the end."""
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], "").cache())
    return tables


def test_empty_table(spark):
    tables = through(spark, spark.createDataFrame([], SCHEMA))
    assert [t.count() for t in tables] == [0] * 6 and all(t.columns == tables[0].columns for t in tables[:5])


def test_repeated_rows_and_clashing_columns(spark):
    text = lambda i: " ".join(f"word{(i * 7 + j * j) % 61} of{i}" for j in range(30))
    plain = [(i, text(i), "(other)" if i % 2 else None, f"s{i % 2}", None) for i in range(30)]
    rows = plain + [plain[3]] * 4 + [(4, text(104), "en", "s0", None), (None, text(5), "en", "s1", 1), (None, text(200), "en", None, 1), (None, text(200), "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for i, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.lit(f"x{i}"))
    tables = through(spark, docs)
    assert all(t.columns == docs.columns for t in tables[:5])
    assert all(r[c] == f"x{i}" for t in tables[1:5] for r in t.collect() for i, c in enumerate(CLASHING))
    kept = Counter((r.doc_id, r.text) for r in tables[3].collect())
    assert kept == Counter([(r[0], r[1]) for r in plain] + [(4, text(104)), (None, text(200))])
    ids = {r.doc_id for r in tables[5].collect()}
    assert ids <= {*range(30), None} and len(ids) > 20  # a source may get less than its size
