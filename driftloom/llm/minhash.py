"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

The sketch is the one of Dahlgaard, Knudsen and Thorup (Fast Similarity Sketching, FOCS 2017):
in each of the first ``t`` rounds every element is thrown, with a fresh hash, into one of ``t``
bins, and a bin keeps the smallest round + fraction; in further rounds all elements go to one bin
each, so every coordinate is filled. Rounds end when all bins are full; coordinates agree with
probability equal to the Jaccard similarity, with concentration as for independent samples.

A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands: at 0.8 with the
default 50 bands of 6 rows it is missed once in four million. Nothing else loses links:
documents with equal sets form a class, and a class is represented by its smallest id. The members
of a bucket are compared with its smallest, and where that leaves a bucket in more components than
one, those components' documents go through an exact prefix filter on rare shingles. No bucket is
capped and no pairs of a group are listed. Links are confirmed on the full sets of 64-bit shingle
hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.components import connected_components
from driftloom.llm.shared import Scratch, mix, shingle_sets, slices, utf8

BANDS, ROWS = 50, 6
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A (len(sets), t) array of coordinates; sets must not be empty."""
    n = len(sets)
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    live = np.arange(n)
    for round_ in range(2 * t):
        if not len(live):
            break
        sizes = np.array([len(sets[i]) for i in live])
        items = np.concatenate([sets[i] for i in live])
        h = mix(items + _STEP * np.array([round_ + 1], np.uint64))
        # the round in the upper bits makes earlier rounds win; fractions keep 48 bits
        value = (np.uint64(round_) << np.uint64(48)) | (h >> np.uint64(16))
        if round_ < t:
            bins = (mix(h + np.uint64(0x5851F42D4C957F2D)) % np.uint64(t)).astype(np.int64)
            np.minimum.at(out, np.repeat(live * t, sizes) + bins, value)
        else:
            low = np.minimum.reduceat(value, np.cumsum(sizes) - sizes)
            at = live * t + (round_ - t)
            out[at] = np.minimum(out[at], low)
        full = (out.reshape(n, t)[live] != np.iinfo(np.uint64).max).all(axis=1)
        live = live[~full]
    return out.reshape(n, t)


def _band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    c = coordinates.reshape(len(coordinates), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), c.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * _STEP + c[:, :, j])
    return key.view(np.int64)


def _sketch_batches(k: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(*utf8(batch.column(1)), k)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), bands), np.int64)
                if some:
                    keys[some] = _band_keys(sketches([sets[i] for i in some], bands * rows), bands, rows)
                lengths = np.zeros(len(sets), np.int32)
                lengths[some] = bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)),
                            pa.array(keys[some].ravel()),
                        ),
                    ],
                    names=["id", "n", "class", "bands"],
                )

    return work


def _set_batches(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(*utf8(batch.column(1)), k)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                body = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(body))], names=["id", "items"]
                )

    return work


def _torn_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) that may be linked though the links to their buckets' leads left them in different components.

    Only components that meet in a bucket matter. Their documents go through an exact prefix
    filter: with shingles from rare to common, two sets that are similar enough share one of the
    first n - ceil(n * percent / 100) + 1 of each, and the place of the first one they share bounds
    their overlap. What sets a document apart from its group are rare shingles, which come first,
    so a document that is linked with nothing has next to no candidates. A shingle's largest
    component is compared with the others only, never with itself.
    """
    named = members.join(labels, members["id"] == labels["node"], "left")
    meets = named.select("bucket", F.coalesce("component", "id").alias("c")).distinct()
    torn = meets.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    torn = meets.join(torn, "bucket", "left_semi").select("c").distinct()
    ids = sets.select("id").distinct()
    ids = ids.join(labels, ids["id"] == labels["node"], "left").select("id", F.coalesce("component", "id").alias("c"))
    ids = scratch.write(ids.join(torn, "c", "left_semi").select("id", "c"))
    items = scratch.write(
        sets.join(ids, "id").select("id", "c", F.size("items").alias("n"), F.explode("items").alias("item"))
    )
    often = items.groupBy("item").agg(F.count("*").alias("df"))
    in_order = items.join(often, "item").groupBy("id").agg(
        F.first("c").alias("c"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "item"))).alias("o")
    )
    prefix = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    spots = F.transform(prefix, lambda x, i: F.struct(x["item"].alias("item"), x["df"].alias("df"), i.alias("p")))
    keys = in_order.select("id", "c", "n", F.inline(F.filter(spots, lambda x: x["df"] > 1)))
    keys = scratch.write(keys.drop("df"))
    scratch.drop(items)
    # the shorter of a pair shares one of its first n - ceil(2 percent n / (100 + percent)) + 1
    index = keys.where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100.0 + percent) - 1e-9))
    index = index.select("item", F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("p").alias("p2"))
    often = keys.groupBy("item", "c").agg(F.count("*").alias("k"))
    often = often.groupBy("item").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count("*").alias("many")).where("many > 1")
    often = scratch.write(often.select("item", "main"))
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100.0 + percent) - 1e-9)
    fits = (
        (F.col("c") != F.col("c2"))
        & (F.col("n") >= F.col("n2"))
        & (100 * F.col("n2") >= percent * F.col("n"))
        & (F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) >= need)
    )
    probe = keys.join(often, "item")
    aside = probe.where("c != main").join(index, "item").where(fits)
    inside = probe.where("c = main").join(index.join(often.withColumnRenamed("main", "main2"), "item").where("c2 != main2"), "item").where(fits)
    pair = (F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
    return aside.select(*pair).unionByName(inside.select(*pair)).distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct
    shingles (A-Z lower-cased; a text of fewer words is one shingle). Null or blank text: an empty
    set, linked with nothing, its own component. Equal sets are always linked. Rows that share an
    id are one document and share a component. A null id takes its class's component (null if
    all of the class are null) and is never kept. Ids are whole numbers; others fail. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    seen = scratch.write(
        slim.mapInArrow(
            _sketch_batches(shingle_words, bands, rows), "id long, n long, class string, bands array<long>"
        )
    )
    filled = seen.where("n > 0 and id is not null")
    classes = scratch.write(filled.groupBy("class").agg(F.min("id").alias("rep"), F.first("n").alias("n")))
    # a bucket of one class cannot link anything; min and max of its members tell without gathering them
    reps = filled.join(classes.select("class", F.col("rep").alias("id")), ["class", "id"], "left_semi")
    spread = reps.dropDuplicates(["class"]).select("id", "n", F.explode("bands").alias("bucket"))
    spread = scratch.write(spread)
    crowded = spread.groupBy("bucket").agg(F.count("*").alias("g"), F.min("id").alias("lead")).where("g > 1")
    members = scratch.write(spread.join(crowded, "bucket").select("bucket", "g", "lead", "id", "n"))
    scratch.drop(spread)
    wanted = members.select("id").distinct()
    sets = scratch.write(
        slim.join(wanted, "id", "left_semi").mapInArrow(_set_batches(shingle_words), "id long, items array<long>")
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}")) for x in ("a", "b"))
        both = pairs.join(a, "a").join(b, "b")
        inter = F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("i")
        return (
            both.select("a", "b", inter, (F.size("items_a") + F.size("items_b")).alias("s"))
            .where(100 * F.col("i") >= percent * (F.col("s") - F.col("i")))
            .select("a", "b")
        )

    fits = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) if percent else F.lit(True)
    ns = sets.select(F.col("id").alias("lead"), F.size("items").alias("n2"))
    first = members.where("id != lead").select(F.col("lead"), "id", "n").distinct().join(ns, "lead").where(fits)
    links = scratch.write(confirmed(first.select(F.col("lead").alias("a"), F.col("id").alias("b"))))
    labels = scratch.write(connected_components(links, "a", "b", scratch))
    more = scratch.write(confirmed(_torn_pairs(members, labels, sets, percent, scratch)))
    if not more.isEmpty():
        labels = scratch.write(connected_components(links.unionByName(more), "a", "b", scratch))
    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "class", F.coalesce("component", "rep").alias("component")
    )
    of_class = scratch.write(of_class)
    return (
        seen.join(of_class, "class", "left")
        .select(
            F.col("id").alias(doc_id),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", F.when(F.col("n") == 0, F.col("id"))).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(False)))
    )
