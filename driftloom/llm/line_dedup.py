"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Words are ordered from rare to common: counts over the
whole corpus, kept in hash buckets that grow with it up to a fixed number, give a level (the
count's logarithm), and words of a level are ordered by hash. Two sets of similarity t that overlap
in two words or more share two of the first |x| - ceil(t |x|) + 2 words of each (prefix filter,
one word longer than needed); where a shared word stands and how long the lines are bounds their
overlap (positional and length filter), and so does a 64-bit parity bitmap of each set. Pairs that
share two such words are verified on the full sets of words.

* Equal lines (but for case) are found first, by 128-bit hashes; all but the first are gone and
  never reach the join, so that a line of any frequency is one row there.
* The lines of a word that many have are first compared with the earliest of them alone; only lines
  that this leaves standing meet all earlier lines of their prefix words.
* A word of a hot bucket makes no group of its own: it is posted together with each later word of
  the prefix, which is exact because a second shared word is sure.

The text is read once for the words' 64-bit hashes, which stand for the words from there on. What is
shuffled for all lines is the prefix, never the text. Only DataFrame functions are used.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch

PERCENT = 80
#: Hash buckets of the word counts, at least and at most; between them one for each CHARS characters.
BUCKETS, CHARS = (1 << 16, 1 << 20), 4096
#: Occurrences from which a bucket is hot, if that is 64 times the mean of all buckets or more.
HOT_COUNT = 4096
#: Lines above which a word's lines first meet the earliest of them alone: groups of near copies leave before they form pairs.
CROWD = 1024
#: Bytes up to which a side is broadcast; above, the join shuffles.
BROADCAST_BYTES = 32 << 20
_HOT = 15 << 58
_LOW = (1 << 58) - 1
_BLANK = " \t\n\x0b\x0c\r"


def _plain(line: Column) -> Column:
    """Lower case, other white space as spaces. Of single lines: one letter beyond ASCII makes a whole text slow to lower."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.lower(F.when(odd, F.regexp_replace(line, r"[\t\x0B\f\r]", " ")).otherwise(line))


def _hashes(line: Column) -> Column:
    """Of the distinct words of a plain line; what lies between two spaces is no word."""
    return F.array_distinct(F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


class _Order:
    """Keys of words that ascend from rare to common."""

    def __init__(self, lines: DataFrame, chars: int):
        """Counts the lines of each word, from their hashes (words)."""
        self.buckets = BUCKETS[0]
        while self.buckets < min(BUCKETS[1], chars // CHARS):
            self.buckets *= 2
        word = lines.select(F.explode("words").alias("w"))
        counts = word.groupBy(F.col("w").bitwiseAND(F.lit(self.buckets - 1)).alias("b")).agg(F.count("*").alias("n")).toPandas()
        hot = max(HOT_COUNT, 64 * int(counts["n"].sum()) // self.buckets)
        self.unit = max(1, hot >> 12)
        table = [0] * self.buckets
        for b, n in zip(counts["b"].tolist(), counts["n"].tolist(), strict=True):
            table[b] = 15 if n >= hot else (n // self.unit).bit_length()
        self.levels = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<tinyint>")

    def _key(self, h: Column) -> Column:
        # never null, so that keys are sorted as plain longs
        level = F.coalesce(F.get(self.levels, h.bitwiseAND(F.lit(self.buckets - 1)).cast("int")), F.lit(0).cast("byte"))
        return F.shiftleft(level.cast("long"), 58).bitwiseOR(h.bitwiseAND(F.lit(_LOW)))

    def keys(self, words: Column) -> Column:
        return F.sort_array(F.transform(words, self._key))

    def crowd(self, key: Column) -> Column:
        """Whether a word may be in more than CROWD lines."""
        return F.shiftrightunsigned(key, 58) >= (CROWD // self.unit).bit_length()


def _join(big: DataFrame, few: DataFrame, on: list[str] | Column, how: str, row_bytes: int) -> DataFrame:
    """Broadcasts ``few`` (a written table) if its rows of about ``row_bytes`` are few enough, else leaves the join to Spark."""
    return big.join(F.broadcast(few) if few.count() * row_bytes <= BROADCAST_BYTES else few, on, how)


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """``docs`` (with dedup_id, dedup_text) with ``base``, the number of its first line, in the order of the ids.

    Also the bits that a line's place in its text takes, and how many characters there are. Whole
    ids that leave room are the numbers themselves; others are ranked, together with a hash of the
    text where an id has more than one. No number: the row has no id or no text.
    """
    hashed = docs.withColumn("dedup_hash", F.xxhash64("dedup_text"))
    known = hashed.where("dedup_id is not null and dedup_text is not null")
    sizes = F.max(F.length("dedup_text")).alias("longest"), F.sum(F.length("dedup_text")).alias("chars")
    each = known.groupBy("dedup_id").agg(F.min("dedup_hash").alias("a"), F.max("dedup_hash").alias("z"), *sizes)
    ends = F.min("dedup_id"), F.max("dedup_id")
    low, high, clash, longest, chars = each.agg(*ends, F.max((F.col("a") != F.col("z")).cast("int")), F.max("longest"), F.sum("chars")).first()
    bits = int(longest or 0).bit_length()
    whole = docs.schema["dedup_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    has = F.col("dedup_id").isNotNull() & F.col("dedup_text").isNotNull()
    if low is None or whole and not clash and (high - low).bit_length() + bits < 63:
        shift = F.shiftleft(F.col("dedup_id").cast("long") - F.lit(low or 0).cast("long"), bits) if whole else F.lit(None).cast("long")
        return docs.withColumn("base", F.when(has, shift)), bits, int(chars or 0)
    keys = known.select("dedup_id", "dedup_hash").distinct().repartitionByRange("dedup_id", "dedup_hash").sortWithinPartitions("dedup_id", "dedup_hash")
    keys = scratch.write(keys.withColumn("row", F.monotonically_increasing_id()))
    # a row's part is above bit 33: one row for each part in the window
    parts = keys.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.write(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")))
    ranked = keys.join(parts, F.shiftright("row", 33) == F.col("part")).select(
        F.col("dedup_id").alias("rank_id"), F.col("dedup_hash").alias("rank_hash"), F.shiftleft(F.col("skip") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1)), bits).alias("base")
    )
    ranked = scratch.write(ranked)
    joined = _join(hashed, ranked, (F.col("dedup_id") == F.col("rank_id")) & (F.col("dedup_hash") == F.col("rank_hash")), "left", 48)
    return joined.drop("rank_id", "rank_hash", "dedup_hash"), bits, int(chars or 0)


#: A post's mark: whether one shared word is enough, a parity bitmap, how many words the line has and which of them this is.
_SIGNS, _MOST = 38, 4095


def _mark(o: Column, n: Column, p: Column, solo: Column) -> Column:
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    bits = F.aggregate(o, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))
    # the upper bits fold onto the lower: still a parity of each cell
    bits = F.transform(F.array(bits), lambda b: b.bitwiseXOR(F.shiftrightunsigned(b, _SIGNS)).bitwiseAND(F.lit((1 << _SIGNS) - 1)))[0]
    return F.shiftleft(solo.cast("long"), 62).bitwiseOR(F.shiftleft(bits, 24)).bitwiseOR(F.shiftleft(F.least(n, F.lit(_MOST)).cast("long"), 12)).bitwiseOR(p)


def _near(x: Column, y: Column, percent: int) -> Column:
    """Bitmap, length and positional filter on two marks; the place of a second shared word passes. Lines too long for a mark pass."""
    signs = F.shiftright(x.bitwiseXOR(y), 24).bitwiseAND(F.lit((1 << _SIGNS) - 1))
    xn, yn = _length(x), _length(y)
    xp, yp = (m.bitwiseAND(F.lit(_MOST)) for m in (x, y))
    near = (
        (100 * F.least(xn, yn) >= percent * F.greatest(xn, yn))
        & ((F.least(xn - xp, yn - yp) + 1) * (100 + percent) >= percent * (xn + yn))
        & (F.bit_count(signs) * (100 + percent) <= (100 - percent) * (xn + yn))
    )
    return near | (F.greatest(xn, yn) == _MOST)


def _length(mark: Column) -> Column:
    return F.shiftright(mark, 12).bitwiseAND(F.lit(_MOST))


def _shorter(mark: Column, percent: int) -> Column:
    """Whether a post can be one of the first two words that its line shares with a line of as many words or more."""
    n = _length(mark)
    lost = n - F.ceil(n * (2 * percent) / (100.0 + percent) - 1e-9)
    return (mark.bitwiseAND(F.lit(_MOST)) < lost + 2) | (n == _MOST)


def matched_lines(texts: DataFrame, bits: int, chars: int, percent: int, scratch: Scratch) -> DataFrame:
    """(c) of every line of (base, text) that has a word and an earlier match: the base and its place in the text."""
    spark = texts.sparkSession
    lines = texts.select("base", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.where((F.left("line", F.lit(1)) > " ") | (F.btrim("line", F.lit(_BLANK)) != ""))
    lines = lines.select((F.col("base") + F.col("no")).alias("c"), _plain(F.col("line")).alias("line"))
    lines = lines.select("c", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), "line").alias("k2"), _hashes(F.col("line")).alias("words"))
    # words come again and again: with room for a dictionary a hash takes less than three bytes
    lines = scratch.write(lines, **{"parquet.dictionary.page.size": str(16 << 20)})
    hashed = lines.select("c", "k1", "k2")
    order = _Order(lines, chars)

    often = hashed.groupBy("k1", "k2").agg(F.min("c").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    often = scratch.write(often.select("k1", "k2", "first"))
    # of its class, but not the first
    copy = (hashed["k1"] == often["k1"]) & (hashed["k2"] == often["k2"]) & (hashed["c"] != often["first"])
    copies = scratch.write(_join(hashed, often, copy, "left_semi", 32).select("c"))
    scratch.drop(often)

    heads = _join(lines, copies, ["c"], "left_anti", 16).select("c", order.keys(F.col("words")).alias("o"))
    n = F.size("o")
    prefix = F.slice("o", F.lit(1), n - F.ceil(n * percent / 100.0 - 1e-9).cast("int") + 2)
    heads = heads.select("c", n.alias("n"), "o", prefix.alias("prefix"))
    hot = (F.col("n") > 1) & (F.element_at("prefix", -1) >= _HOT)
    mark = _mark(F.col("o"), F.col("n"), F.lit(0).cast("long"), hot | (F.col("n") == 1))
    # a hot word with each later one, at the hot word's place; other words alone
    later = lambda w, i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda g: F.struct(F.xxhash64(w, g).alias("w"), i.alias("p")))
    paired = F.flatten(F.transform("prefix", lambda w, i: F.when(w >= _HOT, later(w, i)).otherwise(F.array(F.struct(w.alias("w"), i.alias("p"))))))
    heads = heads.select("c", mark.alias("mark"), "prefix", F.when(hot, paired).alias("paired"))
    keys = F.coalesce(F.transform("paired", lambda x: x["w"]), F.col("prefix"))
    places = F.coalesce(F.transform("paired", lambda x: x["p"]), F.array().cast("array<int>"))
    posts = heads.select("c", "mark", places.alias("places"), F.posexplode(keys).alias("pos", "word"))
    p = F.coalesce(F.get("places", F.col("pos")), F.col("pos"))
    posts = posts.select("word", "c", (F.col("mark") + F.least(p, F.lit(_MOST))).alias("mark"))

    name = f"line_posts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def verified(pairs: DataFrame) -> DataFrame:
        """(c) of the later line x of each pair (x, y) that is similar, by the 64-bit hashes of all words of the two."""
        pairs = scratch.write(pairs)
        wanted = scratch.write(pairs.select(F.col("x").alias("c")).unionByName(pairs.select(F.col("y").alias("c"))).distinct())
        # rows that repeat an id and text give the same lines twice, and the pairs are made distinct in the end
        full = scratch.write(_join(lines.select("c", "words"), wanted, ["c"], "left_semi", 16))
        both = pairs.join(full.select(F.col("c").alias("x"), F.col("words").alias("xw")), "x").join(full.select(F.col("c").alias("y"), F.col("words").alias("yw")), "y")
        enough = (100 + percent) * F.size(F.array_intersect("xw", "yw")) >= percent * (F.size("xw") + F.size("yw"))
        similar = both.where(enough).select(F.col("x").alias("c")).distinct()
        out = scratch.write(similar)
        scratch.drop(pairs, wanted, full)
        return out

    try:
        posts.repartition(parts, "word").write.option("compression", "zstd").bucketBy(parts, "word").saveAsTable(name)
        posts = spark.table(name)
        # hot words' pairs have keys without a level
        crowds = posts.where(order.crowd(F.col("word")) | (F.col("mark") >= 1 << 62)).groupBy("word").agg(F.count("*").alias("lines"), F.min("c").alias("y")).where(F.col("lines") > CROWD)
        crowds = scratch.write(crowds.select("word", "y"))
        x = posts.select("word", F.col("c").alias("x"), F.col("mark").alias("xm"))
        near = _near(F.col("xm"), F.col("ym"), percent)
        found, past = None, None
        if not crowds.isEmpty():
            leads = _join(x, crowds, ["word"], "inner", 16).where("x = y").select("word", "y", F.col("xm").alias("ym"))
            found = verified(_join(x, scratch.write(leads), ["word"], "inner", 24).where((F.col("x") > F.col("y")) & near).select("x", "y").distinct())
            gone = found.withColumnRenamed("c", "x")
            past = scratch.write(_join(x, gone, ["x"], "left_semi", 16).select("word", F.col("x").alias("y"), F.col("xm").alias("ym")))
            x = _join(x, gone, ["x"], "left_anti", 16)
        # of two standing lines the shorter is y, so that fewer words of it are enough; the later one goes
        y = x.where(_shorter(F.col("xm"), percent)).select("word", F.col("x").alias("y"), F.col("xm").alias("ym"))
        xn, yn = _length(F.col("xm")), _length(F.col("ym"))
        met = x.join(y, "word").where(((xn > yn) | (xn == yn) & (F.col("x") > F.col("y"))) & near)
        met = met.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"), "xm", "ym")
        if past is not None:
            met = met.unionByName(_join(x, past, ["word"], "inner", 32).where((F.col("x") > F.col("y")) & near).select("x", "y", "xm", "ym"))
        pairs = met.groupBy("x", "y").agg(F.count("*").alias("words"), F.max(F.greatest("xm", "ym") >= 1 << 62).alias("solo"))
        pairs = scratch.write(pairs.where("words > 1 or solo").select("x", "y"))
        # one similar line is enough: a line of many like each other mostly goes by its earliest
        more = verified(pairs.groupBy("x").agg(F.min("y").alias("y")))
        more = more.unionByName(verified(_join(pairs, more.withColumnRenamed("c", "x"), ["x"], "left_anti", 16)))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop(lines)
    return (copies.unionByName(found) if found else copies).unionByName(more).distinct()


def _marked(docs: DataFrame, row: list, doc_id: str, text: str, percent: int) -> DataFrame:
    """``row`` columns with dedup_id, lines (of the text) and stays (those that are kept)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    slim = docs.select(*row, F.col(doc_id).alias("dedup_id"), F.col(text).cast("string").alias("dedup_text"))
    keyed, bits, chars = _numbered(slim, scratch)
    texts = keyed.where("base is not null").select("base", F.col("dedup_text").alias("text"))
    lost = scratch.write(matched_lines(texts, bits, chars, percent, scratch))
    by_row = lost.groupBy(F.shiftleft(F.shiftright("c", bits), bits).alias("base")).agg(F.collect_list("c").alias("cs"))
    by_row = scratch.write(by_row.select("base", F.transform("cs", lambda c: (c - F.col("base")).cast("int")).alias("gone")))
    both = keyed.join(F.broadcast(by_row) if lost.count() * 16 <= BROADCAST_BYTES else by_row, "base", "left")
    both = both.withColumn("lines", F.split("dedup_text", "\n")).drop("base", "dedup_text")
    stays = F.filter("lines", lambda x, i: ~F.array_contains("gone", i))
    return both.withColumn("stays", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stays)).drop("gone")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, text (what is kept, lines joined again), n_lines, n_removed.

    A line with a word goes if an earlier line, by id and then line number, has a Jaccard
    similarity of at least ``percent`` / 100 (equal lines included); lines without a word stay.
    Null text stays null with no lines; empty text is one empty line. Rows that share an id but
    not the text come one after the other, in the order of a hash of their texts; rows that share
    both are one document and lose the same lines. Lines of rows with a null id take no part and
    stay. An empty table gives an empty result.
    """
    both = _marked(docs, [], doc_id, text, percent)
    return both.select(
        F.col("dedup_id").alias(doc_id),
        F.when(F.col("lines").isNotNull(), F.array_join("stays", "\n")).alias(text),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("stays"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with their columns, the text as :func:`dedup_lines` leaves it.

    Rows that lost lines and have no word left are dropped; rows that lost none stay as they are.
    """
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole")
    both = _marked(docs, [whole], doc_id, text, percent)
    left = F.when(F.col("lines").isNotNull(), F.array_join("stays", "\n"))
    some = F.col("lines").isNull() | (F.size("stays") == F.size("lines")) | (F.btrim(left, F.lit(_BLANK)) != "")
    return both.where(some).select(*(left.alias(c) if c == text else F.col("whole")[c].alias(c) for c in docs.columns))
