"""Quality rules: repetition guards, then distance of a document's histograms from its language.

Two histograms are taken of each document: characters by class, and its language's most frequent
words, counted over all documents, with all other words in one bin. Each is compared with the sum
of that histogram over *all* documents of the language, by the Jensen-Shannon distance (base 2, the
root of the divergence). A document is rejected by a histogram only from a least length on, below
which a histogram says little, and a language is its own reference only from a least number of
documents on; the others are compared together, by characters. Only DataFrame functions are used.
Shuffled are the words with their counts and the sums by language; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import SPACE_CLASS, Scratch

#: Most frequent words of each language that make its word histogram.
COMMON = 15
#: Documents from which on a language is its own reference, and how many languages can be, the largest.
LEAST_DOCUMENTS, MOST_LANGUAGES = 20, 500
# Character classes besides white space, symbols and the rest.
CLASSES = {"digit": "[0-9]", "upper": "[A-Z]", "mark": "[.,;:!?'\"()-]", "beyond_ascii": "[^\\x00-\\x7F]"}
SYMBOLS = "[#*$%&|<>]"

#: Words from which on the histograms count, and the distances above which a document is rejected.
LEAST_WORDS = {"characters": 20, "words": 100}
MOST_DISTANCE = {"characters": 0.3, "words": 0.45}


def _count(text: Column, pattern: str) -> Column:
    """How many characters of a class there are: what is missing without them. (A count of matches would gather each match.)"""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _word_list() -> Column:
    bare = F.btrim("q_text", F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def _word_chars() -> Column:
    return F.length(F.array_join("q_list", "")).cast("long")


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words under ``q_`` names.

    Null text counts as empty. A text's 5-word windows are compared by 64-bit hashes.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("q_text", whole)
    df = df.withColumn("q_list", _word_list())
    df = df.withColumn("q_words", F.size("q_list").cast("long"))
    df = df.withColumn("q_hash", F.transform("q_list", lambda w: F.xxhash64(w)))
    run = F.transform("q_hash", lambda h, i: F.xxhash64(h, *[F.get("q_hash", i + j) for j in range(1, 5)]))
    df = df.withColumn("q_runs", F.slice(run, F.lit(1), F.greatest(F.size("q_hash") - 4, F.lit(0))))
    some = F.size(F.array_distinct("q_runs")) < F.size("q_runs")
    empty = F.array().cast("array<struct<x:bigint,i:int>>")
    pairs = F.transform("q_runs", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    df = df.withColumn("q_sorted", F.when(some, F.sort_array(pairs)).otherwise(empty))
    same = lambda s, o: F.coalesce(s["x"] == F.get("q_sorted", o)["x"], F.lit(False))
    twice = F.filter("q_sorted", lambda s, i: same(s, i - 1) | same(s, i + 1))
    df = df.withColumn("q_at", F.sort_array(F.transform(twice, lambda s: s["i"])))
    gap = F.transform("q_at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("q_at", i + 1) - p, F.lit(5))))
    df = df.withColumn("q_repeat_words", F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x))
    df = df.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    return (
        df.withColumn("q_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
        .withColumn("q_word_chars", _word_chars())
        .withColumn("q_space", F.length("q_text").cast("long") - F.col("q_word_chars"))
        .withColumn("q_symbols", _count(F.col("q_text"), SYMBOLS))
        .drop("q_hash", "q_runs", "q_sorted", "q_at", "q_lines")
    )


def common_words(docs: DataFrame, text: str, lang: str) -> dict[str, list[str]]:
    """The most frequent words of each language with enough documents, by count and then by word: bounded, whatever the corpus."""
    sizes = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("q_lang")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    known = [r.q_lang for r in sizes.orderBy(F.desc("n"), "q_lang").limit(MOST_LANGUAGES).collect()]
    if not known:
        return {}
    low = F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), SPACE_CLASS + "+")
    words = docs.where(F.col(lang).isin(known)).select(F.col(lang).alias("q_lang"), F.explode(low).alias("w")).where("w <> ''")
    counts = words.groupBy("q_lang", "w").agg(F.count("*").alias("n"))
    # each task passes on no more than COMMON words of a language
    first = F.row_number().over(Window.partitionBy("q_lang").orderBy(F.desc("n"), "w"))
    out: dict[str, list[str]] = {x: [] for x in known}
    for r in counts.withColumn("o", first).where(F.col("o") <= COMMON).orderBy("q_lang", "o").collect():
        out[r.q_lang].append(r.w)
    return out


def _histograms(df: DataFrame, lang: str, common: dict[str, list[str]]) -> DataFrame:
    """Adds q_lang (one of ``common``, or null for the rest), q_c and q_w: bins of characters and words."""
    named_lang = F.col(lang).isin(*common) if common else F.lit(False)
    df = df.withColumn("q_lang", F.when(named_lang, F.col(lang)).otherwise(F.lit(None).cast("string")))
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"q_c_{name}", _count(F.col("q_text"), pattern))
    named = ["q_space", "q_symbols", *(f"q_c_{x}" for x in CLASSES)]
    rest = F.length("q_text").cast("long") - sum((F.col(x) for x in named[1:]), F.col(named[0]))
    df = df.withColumn("q_c", F.array(*named, rest))
    words = F.array().cast("array<string>")
    for name, found in common.items():
        words = F.when(F.col("q_lang") == name, F.array(*map(F.lit, found)).cast("array<string>")).otherwise(words)
    # first what is common in any language, a look into one constant set
    either = sorted({w for found in common.values() for w in found})
    some = F.filter("q_list", lambda w: F.lower(w).isin(either)) if either else F.array().cast("array<string>")
    df = df.withColumn("q_common", words).withColumn("q_some", F.transform(some, F.lower))
    df = df.withColumn("q_each", F.transform("q_common", lambda c: (F.size("q_some") - F.size(F.array_remove("q_some", c))).cast("long")))
    return df.withColumn("q_w", F.concat("q_each", F.array(F.col("q_words") - F.aggregate("q_each", F.lit(0).cast("long"), lambda a, x: a + x))))


def js_distance(p: str, q: str) -> Column:
    """Of two arrays of counts, as columns ``p`` and ``q``; 0 if either is empty or sums to nothing."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    share = lambda c: F.transform(c, lambda x: F.try_divide(x.cast("double"), total(c)))
    terms = F.zip_with(share(p), share(q), lambda a, b: (half(a, b) + half(b, a)) / 2)
    return F.sqrt(F.greatest(F.coalesce(total(terms), F.lit(0.0)), F.lit(0.0)))


def _languages(counted: DataFrame) -> DataFrame:
    """The summed histograms of each language."""
    bins = {"q_c": len(CLASSES) + 3, "q_w": COMMON + 1}
    sums = [F.sum(F.get(F.col(c), F.lit(i))).alias(f"{c}_{i}") for c, n in bins.items() for i in range(n)]
    language = counted.groupBy("q_lang").agg(*sums)
    given = [
        F.filter(F.array(*[f"{c}_{i}" for i in range(n)]), lambda x: x.isNotNull()).alias(f"{c}_all") for c, n in bins.items()
    ]
    return language.select("q_lang", *given)


def _with_language(rows: DataFrame, language: DataFrame) -> DataFrame:
    """At most MOST_LANGUAGES rows, and one of null for the rest."""
    named = language.withColumnRenamed("q_lang", "q_of")
    return rows.join(F.broadcast(named), F.col("q_lang").eqNullSafe(F.col("q_of"))).drop("q_of")


def _base_failed() -> Column:
    return (F.col("q_words") < 10) | (100 * F.col("q_repeat_words") > 20 * F.col("q_words"))


def _kept(least_words: dict[str, int], most_distance: dict[str, float]) -> Column:
    far = lambda kind, c: (F.col("q_words") >= least_words[kind]) & (js_distance(c, f"{c}_all") > most_distance[kind])
    return ~_base_failed() & ~far("characters", "q_c") & ~far("words", "q_w")


def assess(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    least_words: dict[str, int] = LEAST_WORDS,
    most_distance: dict[str, float] = MOST_DISTANCE,
) -> DataFrame:
    """One row per input row: id, the base counts, both distances, base_failed and kept.

    Null, empty or blank text has no words and fails the base. A language of too few documents, or
    null, is compared by characters only, with all such documents. Repeated rows are assessed
    alike; a null id stays null. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    slim = docs.select(F.col(doc_id).alias("q_id"), F.col(text).alias("q_raw"), F.col(lang).alias("q_raw_lang"))
    common = common_words(slim, "q_raw", "q_raw_lang")
    counted = _histograms(base_counts(slim, "q_raw"), "q_raw_lang", common)
    counts = ["q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words"]
    table = scratch.write(counted.select("q_id", "q_lang", *counts, "q_c", "q_w"))
    both = _with_language(table, _languages(table))
    return (
        both.select(
            F.col("q_id").alias(doc_id),
            *[F.col(c).alias(f"n_{c[2:]}" if c != "q_word_chars" else "word_chars") for c in counts],
            js_distance("q_c", "q_c_all").alias("character_distance"),
            js_distance("q_w", "q_w_all").alias("word_distance"),
            _base_failed().alias("base_failed"),
            _kept(least_words, most_distance).alias("kept"),
        )
    )


def keep(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least_words: dict[str, int] = LEAST_WORDS,
    most_distance: dict[str, float] = MOST_DISTANCE,
) -> DataFrame:
    """The rows of ``docs`` that :func:`assess` keeps, with all their columns.

    Three scans and no shuffle of rows: the first counts words, the second sums the languages'
    histograms, the third judges each row where it is read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    bare = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("q_text"), F.col(lang).alias("q_raw_lang"))
    bare = bare.withColumn("q_list", _word_list()).withColumn("q_words", F.size("q_list").cast("long"))
    bare = bare.withColumn("q_space", F.length("q_text").cast("long") - _word_chars()).withColumn("q_symbols", _count(F.col("q_text"), SYMBOLS))
    common = common_words(bare, "q_text", "q_raw_lang")
    bins = scratch.write(_histograms(bare, "q_raw_lang", common).select("q_lang", "q_c", "q_w"))
    language = scratch.write(_languages(bins))
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("q_row"), F.col(text).alias("q_raw"), F.col(lang).alias("q_raw_lang"))
    counted = _histograms(base_counts(whole, "q_raw"), "q_raw_lang", common)
    # the verdict is to use the counts, not to be rewritten into their expressions below
    counted = counted.withColumn("q_barrier", F.monotonically_increasing_id())
    return _with_language(counted, language).where((F.col("q_barrier") >= 0) & _kept(least_words, most_distance)).select("q_row.*")
