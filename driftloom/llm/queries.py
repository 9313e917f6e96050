"""One thin query for each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import ann, bpe, chat, decontaminate, importance, infill, line_dedup, lm_score, minhash, mixing, quality, repeats, sql, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path, pattern)
    return bpe.digests(bpe.decode(encoded, path, pattern))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' lines as transcripts show them: conv_id, turn, part, place, role, opens_turn, line.

    A turn begins with a marker, of a style that follows from the turn's hash, but for one turn in
    six, which shows none; later lines never do.
    """
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    style = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6))
    shown = F.initcap("role")
    marker = F.when(style == 0, F.lit("")).when(style == 1, F.concat(F.lit("<|"), "role", F.lit("|> "))).when(style == 2, F.concat(F.lit("### "), shown, F.lit(": ")))
    marker = F.coalesce(marker.when(style == 3, F.concat(F.lit("["), shown, F.lit("] "))).otherwise(F.concat(shown, F.lit(": "))), F.lit(""))
    cells = turns.select("conv_id", "turn", "role", F.posexplode(F.split(F.concat(marker, "text"), "\n")).alias("part", "line"))
    # a line's place: turns and lines below two to the 31st each
    return cells.withColumn("place", F.shiftleft(F.col("turn"), 31) + F.col("part")).withColumn("opens_turn", F.col("part") == 0)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a transcript whose roles are found again, and its canonical lines.

    The table names the roles, which the transcripts hide in part. The model is counted on the
    conversations whose id's crc32 leaves 2 when divided by 7, all of them, and used on every one.
    A turn of another role than the three is shown by a marker that none of them has, and is given
    one of the three.
    """
    cells = _transcripts(spark, sf_dir)
    teach = cells.where(F.crc32(F.col("conv_id").cast("string")) % 7 == 2)
    model = chat.fitted(teach, "conv_id", "place", "line", "role", "opens_turn")
    out = chat.format_lines(cells, "conv_id", "place", "line", ["turn", "part", "role", "opens_turn"], model)
    return out.select("conv_id", "turn", "part", "role", "found_role", "opens_turn", F.col("opens").alias("opens_found_turn"), "rendered")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents on 2-word shingles at 0.8."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, shingle_words=2, percent=80)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines like an earlier one."""
    left = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict on every document."""
    return quality.assess(_table(spark, sf_dir, "documents")).drop("character_distance", "word_distance")


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to 200-byte strings that start elsewhere too."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source", "copies")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document by the recurrent model, and by counts."""
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a dated list.

    The tables have neither fetch times nor lists. The fetch time follows from the page's id, and
    the list's log from the hosts: most hosts are added, removed and added again on days that
    follow from the name's length; their parent zones are listed for paths below /en/.
    """
    at = F.timestamp_add("HOUR", (F.col("page_id") * 7919 % 8760).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()

    def events(shifts: str) -> DataFrame:
        return hosts.select("host", F.inline(F.expr(f"array({shifts})")).alias("action", "shift"))

    day = lambda start, n: F.timestamp_add("DAY", n.cast("int"), F.lit(start).cast("timestamp"))
    by_host = events("struct('add', 0), struct('remove', 70), struct('add', 160)").where("length(host) % 3 <> 0")
    by_host = by_host.select(F.lit("hosts").alias("list"), "host", F.lit("/").alias("path"), "action", day("2024-01-01", F.length("host") * 17 % 150 + F.col("shift")).alias("at"))
    zone = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    by_zone = events("struct('add', 0), struct('add', 20), struct('remove', 90)")
    by_zone = by_zone.select(F.lit("zones").alias("list"), zone.alias("host"), F.lit("/en/").alias("path"), "action", day("2024-03-01", F.col("shift")).alias("at")).distinct()
    return url_filter.evaluate(pages, by_host.unionByName(by_zone)).withColumn("lists", F.array_join("lists", ","))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark's texts, and the rank of those drawn."""
    return importance.importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items, and which items those are."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    named = F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", *named, (F.col("n_hit") > 0).alias("contaminated"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three by lines and put together for infilling, and what the output restores to."""
    out = infill.restored(infill.infilled(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_chat_format": op2_chat_format,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_mixing": op8_mixing,
    "op9_lm_score": op9_lm_score,
    "op10_url_filter": op10_url_filter,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_decontamination": op12_decontamination,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": sql.op3(),
    "op4_line_dedup": sql.op4(),
    "op5_quality_rules": sql.op5(),
    "op6_suffix_repeats": sql.op6(),
    "op10_url_filter": sql.op10(),
    "op11_importance_resampling": sql.op11(),
    "op12_decontamination": sql.op12(),
    "op13_fill_in_middle": sql.op13(),
}
