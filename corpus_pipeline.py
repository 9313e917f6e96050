"""From raw documents to token ids in five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import bpe, line_dedup, minhash, mixing, quality
from driftloom.llm.shared import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines like an earlier one; n_chars follows the text."""
    left = line_dedup.without_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8).

    Rows that repeat an id and text are one document, of which one row stays. Rows without an id
    stay once for each text that no row with an id has.
    """
    judged = minhash.near_duplicates(docs, shingle_words=5, percent=80)
    lost = judged.where(F.col("doc_id").isNotNull() & ~F.col("kept")).select(F.col("doc_id").alias("lost_id")).distinct()
    # rows travel as one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    whole = lambda df: df.select(*(F.col("row")[c].alias(c) for c in docs.columns))
    left = rows.join(lost, F.col("row")["doc_id"] == F.col("lost_id"), "left_anti")
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if often.isEmpty():
        return whole(left)
    odd = Scratch(spark, "repeated-ids").write(often.select(F.col("doc_id").alias("odd_id")))
    is_odd = F.col("row")["doc_id"].eqNullSafe(F.col("odd_id"))
    found = left.join(odd, is_odd, "left_semi").select("row", F.col("row")["doc_id"].alias("id"), F.col("row")["text"].alias("text"))
    once = found.dropDuplicates(["id", "text"])
    named = docs.where("doc_id is not null").select(F.col("text").alias("named_text"))
    nameless = once.where("id is null").join(named, F.col("text") == F.col("named_text"), "left_anti")
    kept = left.join(odd, is_odd, "left_anti").unionByName(once.where("id is not null").select("row")).unionByName(nameless.select("row"))
    return whole(kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the token ids of each document, and what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("byte bpe", byte_bpe),
]

#: SQL has no byte-pair merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes once the next one is written."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs)
            if i:
                scratch.drop(before)
    return docs
