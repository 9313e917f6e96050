"""Benchmark decontamination by a prefix-filtered join of shingles.

A benchmark item is the set of its windows: runs of ``window`` words, or all of its words where it
has fewer. A window occurs in a document if all of its shingles (runs of ``shingle`` words) occur
there at their places. That is containment of 1, for which the prefix filter needs one shingle of
each window: the rarest. Rarity is counted over all documents.

* Documents are normalised once and dealt into shingles; those that no window has leave before any
  shuffle. What is left is written once, with row, place and words, and counted.
* A window one of whose shingles occurs nowhere is gone. Every other one is looked for by its rarest
  shingle only, at the places that leave room for the rest of the window on both sides.
* That room is the stretch of shingles, each one place behind the last, around it (positional and
  length bound): a shingle that no window has ends it, and most stretches are too short. The words
  at each such place are cut out of the stretch and joined with the windows as text: an exact check
  that reads no document again.

Windows that items share are one row, and documents with the same set of windows look their items
up once. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch

WINDOW, SHINGLE = 10, 3
#: Bytes up to which a side is broadcast; above, the join shuffles.
BROADCAST_BYTES = 32 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: every ASCII character but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOUND, _LOOKED = "array<struct<first:int,after:int>>", "array<struct<skip:int,k:int>>"


def normalised(text: Column) -> Column:
    """The words with A-Z lower-cased, between single spaces; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.trim(F.regexp_replace(low, SEPARATORS, " "))


def _words(norm: str) -> Column:
    return F.when(F.col(norm) == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def _few(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _shingles(df: DataFrame, keep: list[str], size: int) -> DataFrame:
    """(*keep, pos, t, words): each run of ``size`` words in the column ``w``, its hash, and where it starts."""
    runs = F.arrays_zip(*(F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(size)))
    cells = df.where(F.size("w") >= size).select(*keep, F.posexplode(runs).alias("pos", "run"))
    words = [F.col(f"run.w{i}") for i in range(size)]
    return cells.where(words[-1].isNotNull()).select(*keep, "pos", F.xxhash64(*words).alias("t"), F.array(*words).alias("words"))


def _windows(items: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(win, text, k) of each different window, and (item, win)."""
    words = items.select("item", _words("norm").alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
    each = scratch.write(words.select("item", k.alias("k"), F.explode(cut).alias("text")).distinct())
    wins = scratch.write(each.groupBy("text", "k").agg(F.lit(1)).select(F.monotonically_increasing_id().alias("win"), "text", "k"))
    return wins, scratch.write(each.where("item is not null").join(wins, ["text", "k"]).select("item", "win"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted ids as strings), spans (first, after: word places).

    A word is hit if it lies in an occurrence of a window. Null and empty texts have no words and
    no hits; items without words have no windows. Items without an id mark words but are not named;
    items that repeat an id are one. Rows that repeat an id are judged each by itself. Without
    items nothing is hit; without documents there are no rows. Other columns play no part.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    spark = docs.sparkSession
    norm = docs.select(F.col(doc_id).alias("id"), normalised(F.col(text)).alias("norm"))
    texts = scratch.write(norm.select(F.monotonically_increasing_id().alias("row"), "id", F.size(_words("norm")).alias("n"), "norm"))
    wins, members = _windows(items.select(F.col(item_id).cast("string").alias("item"), normalised(F.col(item_text)).alias("norm")), window, scratch)
    n_wins = wins.count()
    sizes = [r.s for r in wins.select(F.least("k", F.lit(shingle)).alias("s")).distinct().collect()]

    parts = wins.select("win", "k", F.split("text", " ").alias("w"))
    ordered = spark.createDataFrame([], "win long, k int, pos int, t long")
    for s in sizes:  # at most ``shingle`` of them
        ordered = ordered.unionByName(_shingles(parts.where(F.least("k", F.lit(shingle)) == s), ["win", "k"], s).drop("words"))
    ordered = scratch.write(ordered)
    tokens = scratch.write(ordered.select("t").distinct())
    n_tokens = tokens.count()

    cells = texts.select("row", _words("norm").alias("w"))
    posts = spark.createDataFrame([], "row long, pos int, t long, words array<string>, size int")
    for s in sizes:
        posts = posts.unionByName(_shingles(cells, ["row"], s).join(_few(tokens, n_tokens, 16), "t", "left_semi").withColumn("size", F.lit(s)))
    posts = scratch.write(posts)

    often = posts.groupBy("t").agg(F.count("*").alias("often"))
    ranked = ordered.join(often, "t", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    rarest = ranked.groupBy("win", "k").agg(F.min(F.struct("often", "t", "pos")).alias("r")).where("r.often > 0")
    # at most one entry for each place in a window
    prefix = scratch.write(rarest.groupBy(F.col("r.t").alias("t")).agg(F.collect_set(F.struct(F.col("r.pos").alias("skip"), "k")).alias("looked")))

    marked = posts.join(_few(prefix, prefix.count(), 24 * window), "t", "left")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("row", "size").orderBy("pos"))
    cell = F.struct("pos", "words", "looked")
    islands = marked.withColumn("island", island).groupBy("row", "size", "island").agg(
        F.min("pos").alias("low"), (F.max("pos") + F.first("size")).alias("high"), F.sort_array(F.collect_list(cell)).alias("cells")
    )
    starts = F.flatten(F.transform("cells", lambda c: F.transform(F.coalesce(c["looked"], F.array().cast(_LOOKED)), lambda x: F.struct((c["pos"] - x["skip"]).alias("first"), x["k"].alias("k")))))
    fits = F.filter(F.array_distinct(starts), lambda s: (s["first"] >= F.col("low")) & (s["first"] + s["k"] <= F.col("high")))
    told = F.concat(F.col("cells")[0]["words"], F.flatten(F.transform(F.slice("cells", 2, F.size("cells")), lambda c: F.slice(c["words"], -1, 1))))
    near = islands.select("row", "low", fits.alias("fits"), told.alias("w")).where(F.size("fits") > 0)
    cut = F.transform("fits", lambda s: F.struct(s["first"].alias("first"), s["k"].alias("k"), F.array_join(F.slice("w", s["first"] - F.col("low") + 1, s["k"]), " ").alias("text")))
    near = near.select("row", F.inline(cut))
    hits = scratch.write(near.join(_few(wins, n_wins, 160), ["text", "k"]).select("row", "first", "k", "win"))

    by = Window.partitionBy("row").orderBy("first", F.desc("k"))
    before = F.max(F.col("first") + F.col("k")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("opens", (before.isNull() | (F.col("first") > before)).cast("int")).withColumn("run", F.sum("opens").over(by))
    runs = runs.groupBy("row", "run").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("k")).alias("after"))
    cover = runs.groupBy("row").agg(F.sum(F.col("after") - F.col("first")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "after"))).alias("spans"))

    sets = hits.groupBy("row").agg(F.sort_array(F.collect_set("win")).alias("wins"))
    sets = scratch.write(sets.withColumn("set", F.sha2(F.array_join("wins", ","), 256)))
    named = sets.groupBy("set").agg(F.first("wins").alias("wins")).select("set", F.explode("wins").alias("win")).join(members, "win")
    named = named.groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = scratch.write(cover.join(sets.select("row", "set"), "row").join(named, "set", "left").select("row", "n_hit", "spans", "items"))

    # a row holds two short arrays; their bytes are summed, not guessed
    bytes_ = found.agg(F.coalesce(F.sum(64 + 16 * F.size("spans") + 32 * F.size(F.coalesce("items", F.array()))), F.lit(0))).first()[0]
    out = texts.select("row", "id", "n").join(_few(found, int(bytes_), 1), "row", "left")
    return out.select(
        F.col("id").alias(doc_id),
        F.col("n").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast(_FOUND)).alias("spans"),
    )
