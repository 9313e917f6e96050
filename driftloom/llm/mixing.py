"""Mixing sources to target weights by fitting each source's budget with whole documents.

Documents are counted by exact length for each source; those counts are all that the fitting
sees. A source's budget first takes its whole copies of everything, then a proportional share of
each length, then the longest documents that still fit; what is left, a bounded number of words,
is met by a bounded-knapsack dynamic program over the counts that remain. Which documents of a
length are taken follows a seeded hash: a length with many documents is cut into hash buckets of
about a thousand, so that only within one bucket documents are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import WORD_PATTERN, Scratch

WEIGHTS = (5, 2, 1)
#: Words that the dynamic program may be left with, besides one document's length.
FIT_WORDS = 4096
BUCKET_ROWS = 1024


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near ``budget`` as the steps find.

    Proportional share, then the longest that fit while more than ``most`` words are left, then the
    exact optimum of the rest. The sum never exceeds the budget.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    whole = int((lengths * counts).sum())
    if budget >= whole:
        return counts.copy()
    take = np.array([int(c) * budget // whole for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= most:
            break
        n = int(min(counts[i] - take[i], (left - most + lengths[i] - 1) // lengths[i], left // lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    return take + knapsack(lengths, counts - take, left)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts whose words are the largest sum up to ``budget`` that can be reached.

    Reachable sums are the bits of one integer; a count is split into powers of two.
    """
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for i, (n, c) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if not 0 < n <= budget:
            continue
        c, k = min(c, budget // n), 1
        while c > 0 and not reach >> budget & 1:
            k = min(k, c)
            steps.append((i, k, reach))
            reach |= (reach << (k * n)) & mask
            c -= k
            k *= 2
    at, out = reach.bit_length() - 1, np.zeros(len(lengths), np.int64)
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            out[i] += k
            at -= k * int(lengths[i])
    return out


def targets(sizes: DataFrame, weights: Sequence[int], percent: int, copies: int) -> DataFrame:
    """(source, source_size, target) from (source, words): shares by weight, none above ``copies`` times its size.

    Water filling in closed form: a source is full if its cap over its weight is small enough that
    all sources with no larger ratio are full too. Sources are few: one row each.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    df = sizes.withColumn("w", F.get(cycle, (F.row_number().over(one) - 1) % len(weights)).cast("double"))
    df = df.withColumn("cap", F.col("words").cast("double") * copies)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = (
        df.withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("words").over(everything) * percent / 100.0)
    )
    # the level (words for each unit of weight) if exactly the sources before this one are full
    df = df.withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("w_left"))
    df = df.withColumn("over", F.col("level") * F.col("w") < F.col("cap"))
    df = df.withColumn("final", F.min(F.when(F.col("over"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap")))
    return df.select("source", F.col("words").alias("source_size"), target.alias("target"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    percent: int = 150,
    copies: int = 2,
    seed: int = 1,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    The size is the number of words (null text: 0). Sources in code point order, null last, weigh
    ``weights`` in turn; ``percent`` of all words is shared by weight, no source above ``copies``
    times its size. copies of a row come into the mix, taken = copies * size. Rows without words
    are taken as often as full copies are. Rows that are equal in id, source and size rank in no
    defined order among themselves, but as many of them are taken on each run. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    table = scratch.write(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), size.alias("size")))
    lengths = scratch.write(table.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = scratch.write(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), weights, percent, copies))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        whole, budget = int(pdf["source_size"].iloc[0]), round(float(pdf["target"].iloc[0]))
        full = budget // whole if whole else 1
        extra = fill(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget - full * whole) if budget > full * whole else np.zeros(len(pdf), np.int64)
        extra[pdf["size"].to_numpy() == 0] = 0
        return pdf.assign(full=full, extra=extra)[["source", "size", "n", "full", "extra"]]

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    kind = table.schema["source"].dataType.simpleString()
    # one row per distinct length of a source, however many documents there are
    fitted = lengths.join(goal, same(lengths, goal)).select(lengths["*"], "source_size", "target")
    plan = scratch.write(fitted.groupBy("source").applyInPandas(fit, f"source {kind}, size long, n long, full long, extra long"))

    keys = ["source", "size"]
    both = table.join(plan, table["source"].eqNullSafe(plan["source"]) & (table["size"] == plan["size"])).select(
        table["*"], "n", "full", "extra", F.xxhash64(F.lit(seed), table["id"], table["size"]).alias("h")
    )
    both = both.withColumn("bucket", F.pmod(F.col("h"), F.ceil(F.col("n") / BUCKET_ROWS)))
    filled = both.where("extra > 0 and extra < n").groupBy(*keys, "bucket").agg(F.count("*").alias("in_bucket"), F.first("extra").alias("want"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = filled.withColumn("before", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    cut = cut.withColumn("take", F.greatest(F.lit(0), F.least("in_bucket", F.col("want") - F.col("before"))))
    cut = scratch.write(cut.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), "in_bucket", "take"))
    joined = both.join(
        cut, both["source"].eqNullSafe(cut["s"]) & (both["size"] == cut["z"]) & (both["bucket"] == cut["b"]), "left"
    ).drop("s", "z", "b")
    partly = (F.col("take") > 0) & (F.col("take") < F.col("in_bucket"))
    rank = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("h", "id"))
    ranked = joined.where(partly).withColumn("more", (rank <= F.col("take")).cast("long"))
    whole = joined.where(~F.coalesce(partly, F.lit(False))).withColumn(
        "more", ((F.col("extra") > 0) & (F.coalesce("take", "n") > 0)).cast("long")
    )
    out = ranked.unionByName(whole)
    copies_ = F.col("full") + F.col("more")
    return out.join(goal, out["source"].eqNullSafe(goal["source"])).select(
        F.col("id").alias(doc_id),
        out["source"].alias(source),
        "size",
        "source_size",
        "target",
        copies_.alias("copies"),
        (copies_ * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix` takes it.

    Rows that share an id are taken equally often, as often as the one taken most.
    """
    often = mix(docs, doc_id, text, source, **more).groupBy(F.col(doc_id).alias("mix_id")).agg(F.max("copies").alias("mix_copies"))
    # the row travels as one column, so that no name of its own can clash
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    joined = whole.join(often, F.col("row")[doc_id].eqNullSafe(F.col("mix_id"))).where("mix_copies > 0")
    each = joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return each.select(*(F.col("row")[c].alias(c) for c in docs.columns))
