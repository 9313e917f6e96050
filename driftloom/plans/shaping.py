"""Masks, samples, order, batches, column kinds, discretisation, lookups and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.operators import frames, order
from driftloom.operators.lineage import folder
from driftloom.plans.registry import register
from driftloom.plans.tables import FEATURES, LONG, MASKED, MATRIX, draw, long, masked_long, matrix, table
from driftloom.sources import readers

_ROW = f"WITH {MATRIX}, x AS (SELECT row_id, user_id, label, [f0, f1, f2, f3] AS fs FROM m)"
_sum = lambda c: F.round(F.aggregate(F.filter(c, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), 6)
_holes = lambda c: F.size(F.filter(c, lambda x: x.isNull())).cast("long")


def _rows(spark, sf_dir):
    return matrix(spark, sf_dir).select("row_id", "user_id", "label", F.array(*FEATURES).alias("fs"))


@register("mask_pairs", f"WITH {MASKED} SELECT row_id, count(*) - count(value) AS holes, round(coalesce(sum(value), 0), 6) AS total FROM k GROUP BY row_id")
def mask_pairs(spark, sf_dir):
    """M1: of each pair of neighbouring columns one cell is masked."""
    fs = frames.mask_pairs(F.col("fs"), F.col("row_id"))
    return _rows(spark, sf_dir).select("row_id", fs.alias("fs")).select("row_id", _holes("fs").alias("holes"), _sum("fs").alias("total"))


@register("mask_fraction", f"""WITH {LONG}, d AS (SELECT *, {draw('row_id', 'feature_id')} AS u FROM l), w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY u DESC, feature_id) AS r FROM d)
SELECT row_id, count(*) FILTER (WHERE u < 858993458 AND r > 1) AS holes FROM w GROUP BY row_id""")  # fmt: skip
def mask_fraction(spark, sf_dir):
    """M2: two cells in five are masked, but never all of a row."""
    return frames.mask_fraction(long(spark, sf_dir), 0.4).groupBy("row_id").agg(F.count_if(F.col("value").isNull()).alias("holes"))


@register("mask_per_row", f"""WITH {LONG}, w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {draw('row_id', 'feature_id', 7)}, feature_id) AS r FROM l)
SELECT feature_id, count(*) FILTER (WHERE r <= 2) AS holes, round(sum(value) FILTER (WHERE r > 2), 4) AS total FROM w GROUP BY feature_id""")  # fmt: skip
def mask_per_row(spark, sf_dir):
    """M3: two cells of each row are masked."""
    m = frames.mask_per_row(long(spark, sf_dir), 2, 7)
    return m.groupBy("feature_id").agg(F.count_if(F.col("value").isNull()).alias("holes"), F.round(F.sum("value"), 4).alias("total"))


@register("scarce_labels", f"WITH {MATRIX} SELECT row_id, CASE WHEN row_id = 0 OR {draw('row_id', '0', 3)} >= 1073741823 THEN label END AS label FROM m")
def scarce_labels(spark, sf_dir):
    """Half of the rows keep their label."""
    return matrix(spark, sf_dir).select("row_id", F.when(frames.labelled(F.col("row_id"), 0.5, 3), F.col("label")).alias("label"))


@register("zero_fill_bias", f"WITH {MASKED} SELECT row_id, 5::BIGINT AS width, round(1 + sum(coalesce(value, 0)), 6) AS total FROM k GROUP BY row_id")
def zero_fill_bias(spark, sf_dir):
    """M5, M6: masked cells are 0 and a bias column comes first."""
    fs = frames.with_bias(frames.fill_zero(frames.mask_pairs(F.col("fs"), F.col("row_id"))))
    return _rows(spark, sf_dir).select("row_id", fs.alias("fs")).select("row_id", F.size("fs").cast("long").alias("width"), _sum("fs").alias("total"))


@register("permuted_stream", f"WITH {MATRIX} SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY {draw('row_id', '0', 1)}, row_id) - 1 AS place FROM m")
def permuted_stream(spark, sf_dir):
    """Each user's stream in a seeded order."""
    w = Window.partitionBy("user_id").orderBy(frames.draw(F.col("row_id"), 0, 1), "row_id")
    return matrix(spark, sf_dir).select("row_id", (F.row_number().over(w) - 1).cast("long").alias("place"))


@register("interleaved_classes", f"""WITH {MATRIX}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY row_id) - 1 AS i, count(*) FILTER (WHERE label = 0) OVER (PARTITION BY user_id) AS c, count(*) FILTER (WHERE label = 1) OVER (PARTITION BY user_id) AS d FROM m)
SELECT row_id, CASE WHEN label = 0 THEN i + least(CAST(ceil(i / 2.0) AS BIGINT), d) WHEN i < ceil(c / 2.0) THEN i * 3 + 1 ELSE c + i END AS place FROM r""")  # fmt: skip
def interleaved_classes(spark, sf_dir):
    """M8: after every second row of the larger class one of the smaller, in closed form."""
    per = Window.partitionBy("user_id")
    m = matrix(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id", "label").orderBy("row_id")) - 1)
    m = m.withColumns({"c": F.count_if(F.col("label") == 0).over(per), "d": F.count_if(F.col("label") == 1).over(per)})
    return m.select("row_id", frames.interleaved(F.col("label"), F.col("i"), F.col("c"), F.col("d"), 2).alias("place"))


@register("circular_batches", f"""WITH {MATRIX}, n AS (SELECT count(*) AS n FROM m), e AS (SELECT row_id, n, unnest([0, 1]) AS epoch FROM m, n)
SELECT CAST(floor((epoch * n + row_id) / 700) AS BIGINT) AS batch_id, count(*) AS rows, min(row_id) AS first, count(*) FILTER (WHERE row_id % 3 = 0) AS labelled FROM e GROUP BY ALL""")  # fmt: skip
def circular_batches(spark, sf_dir):
    """Two passes over the stream in batches that wrap around; whether a row's label is known goes with it."""
    m = matrix(spark, sf_dir).withColumn("is_labelled", F.col("row_id") % 3 == 0)
    b = frames.batches(m, "row_id", m.count(), 700)
    return b.groupBy("batch_id").agg(F.count("*").alias("rows"), F.min("row_id").alias("first"), F.count_if("is_labelled").alias("labelled"))


@register("trapezoid_stream", _ROW + """, n AS (SELECT *, count(*) OVER () AS n FROM x), t AS (SELECT row_id, fs[1:least(4, (floor(row_id / ceil(n / 5.0)) + 1) * 1)::INT] AS fs FROM n)
SELECT row_id, len(fs) AS width, round(list_sum(fs), 6) AS total, 4::BIGINT AS padded FROM t""")  # fmt: skip
def trapezoid_stream(spark, sf_dir):
    """S3, M5: later rows show more columns; padded to full width."""
    rows = _rows(spark, sf_dir)
    t = rows.select("row_id", frames.trapezoid(F.col("fs"), F.col("row_id"), F.lit(rows.count())).alias("fs"))
    return t.select("row_id", F.size("fs").cast("long").alias("width"), _sum("fs").alias("total"), F.size(frames.pad(F.col("fs"), 4)).cast("long").alias("padded"))


@register("ragged_text", f"WITH {MASKED} SELECT row_id, round(sum(coalesce(value, 0)), 6) AS total FROM k GROUP BY row_id")
def ragged_text(spark, sf_dir):
    """Rows written as bracketed text and parsed again, NaN as 0."""
    fs = frames.mask_pairs(F.col("fs"), F.col("row_id"))
    return _rows(spark, sf_dir).select("row_id", _sum(readers.parse_ragged(readers.ragged_text(fs))).alias("total"))


@register("files_round_trip", f"""WITH {MASKED}, r AS (SELECT row_id, [max(value) FILTER (WHERE feature_id = 0), max(value) FILTER (WHERE feature_id = 1), max(value) FILTER (WHERE feature_id = 2), max(value) FILTER (WHERE feature_id = 3)] AS x FROM k GROUP BY row_id),
c AS (SELECT [round(50 - f0, 4), f1, f2, f3] AS x FROM m),
s AS (SELECT 'ragged' AS file, list_transform(x, lambda v: coalesce(v, 0)) AS x FROM r UNION ALL SELECT 'csv', x FROM c UNION ALL SELECT 'magnitudes', list_transform(x, lambda v: abs(v)) FROM c UNION ALL SELECT 'series', [label::DOUBLE] FROM m)
SELECT file, count(*) AS n, round(sum(x[1]), 4) AS first, round(sum(list_sum(x)), 4) AS total FROM s GROUP BY file""")
def files_round_trip(spark, sf_dir):
    """The stream written as ragged rows, as CSV and as a series of labels, and read again, CSV with and without signs."""
    rows, at = _rows(spark, sf_dir), f"{folder(spark)}/files-{uuid.uuid4().hex}"
    readers.write_ragged(rows.select("row_id", frames.mask_pairs(F.col("fs"), F.col("row_id")).alias("x")), f"{at}/ragged", "x", "row_id")
    signed = [F.round(50 - F.col("fs")[0], 4).alias("f0"), *(F.col("fs")[i].alias(f"f{i}") for i in (1, 2, 3))]
    readers.write_csv(rows.select(*signed), f"{at}/csv")
    readers.write_series(matrix(spark, sf_dir).select("row_id", "label"), f"{at}/series", "label", "row_id")
    read = {"ragged": readers.read_ragged(spark, f"{at}/ragged"), "csv": readers.read_matrix(spark, f"{at}/csv", 4, ",", header=True),
            "magnitudes": readers.read_matrix(spark, f"{at}/csv", 4, ",", absolute=True, header=True),
            "series": readers.read_vector(spark, f"{at}/series").select(F.array("value").alias("features"))}
    parts = [df.select(F.lit(name).alias("file"), "features") for name, df in read.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("file").agg(F.count("*").alias("n"), F.round(F.sum(F.col("features")[0]), 4).alias("first"), F.round(F.sum(_whole("features")), 4).alias("total"))


def _whole(values: str):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


@register("stream_settings", "SELECT * FROM (VALUES ('cap', 'australian', 0.01E0, 2, 10, 4, false), ('cap', 'wdbc', 0.02E0, 2, 8, 0, true), ('tra', 'australian', 0.02E0, 2, 10, 4, false), ('tra', 'wdbc', 0.0E0, 2, 2, 3, true)) t(kind, dataset, contribute_error_rate, window_den, batch_den, decay_choice, shuffle)")
def stream_settings(spark, sf_dir):
    """Hyper-parameters by data set and kind of stream."""
    return readers.settings(spark)


@register("column_kinds", f"WITH {LONG} SELECT feature_id, count(DISTINCT value) >= 15 AS is_cont FROM l GROUP BY feature_id")
def column_kinds(spark, sf_dir):
    """Columns with more than 14 distinct values are continuous."""
    return frames.continuous_features(long(spark, sf_dir))


@register("binary_cut", f"""WITH {LONG}, q AS (SELECT feature_id, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS z FROM l GROUP BY feature_id),
d AS (SELECT feature_id, value AS cut FROM (SELECT l.*, row_number() OVER (PARTITION BY feature_id ORDER BY {draw('row_id', 'feature_id')}, row_id) AS o FROM l JOIN q USING (feature_id) WHERE value BETWEEN a AND z) WHERE o = 1)
SELECT feature_id, CAST(value > cut AS INT) AS bit, count(*) AS rows FROM l JOIN d USING (feature_id) GROUP BY ALL""")  # fmt: skip
def binary_cut(spark, sf_dir):
    """Columns cut in two at a value drawn from between the tenth and ninetieth percentile."""
    cells = long(spark, sf_dir)
    return frames.binary(cells, frames.drawn_cut(cells)).groupBy("feature_id", "bit").agg(F.count("*").alias("rows"))


@register("equal_width_ordinal", f"""WITH {LONG}, e AS (SELECT feature_id, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature_id)
SELECT feature_id, (value > lo + (hi - lo) * 1 / 4)::INT + (value > lo + (hi - lo) * 2 / 4)::INT + (value > lo + (hi - lo) * 3 / 4)::INT + (value > lo + (hi - lo) * 4 / 4)::INT AS ordinal, count(*) AS rows FROM l JOIN e USING (feature_id) GROUP BY ALL""")  # fmt: skip
def equal_width_ordinal(spark, sf_dir):
    """Four cuts of equal width; the largest value never exceeds the last."""
    return frames.equal_width(long(spark, sf_dir), 4).groupBy("feature_id", "ordinal").agg(F.count("*").alias("rows"))


@register("quantile_ordinal", f"""WITH {LONG}, q AS (SELECT feature_id, quantile_cont(value, [0.05, 0.5, 0.95]) AS c FROM l GROUP BY feature_id)
SELECT feature_id, (value >= c[1])::INT + (value >= c[2])::INT + (value >= c[3])::INT AS ordinal, count(*) AS rows FROM l JOIN q USING (feature_id) GROUP BY ALL""")  # fmt: skip
def quantile_ordinal(spark, sf_dir):
    """P5, A5: cuts at exact quantiles."""
    return frames.quantile_cuts(long(spark, sf_dir), [0.05, 0.5, 0.95]).groupBy("feature_id", "ordinal").agg(F.count("*").alias("rows"))


_BINS = f"""WITH {LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY value, row_id) - 1 AS i, count(*) OVER (PARTITION BY feature_id) AS c FROM l),
b AS (SELECT feature_id, CAST(floor(i / greatest(floor(c / 10), 1)) AS BIGINT) AS bin, min(value) AS lo, max(value) AS hi FROM r
  WHERE feature_id IN (SELECT feature_id FROM l GROUP BY feature_id HAVING count(DISTINCT value) > 10) GROUP BY ALL)"""


@register("equal_frequency_bins", _BINS + " SELECT feature_id, bin, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b")
def equal_frequency_bins(spark, sf_dir):
    """Sorted values in ten chunks of equal size."""
    return frames.equal_frequency(long(spark, sf_dir)).select("feature_id", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@register("discretised", _BINS + " SELECT l.row_id, l.feature_id, max(bin) AS bin FROM l LEFT JOIN b ON l.feature_id = b.feature_id AND value BETWEEN lo AND hi GROUP BY ALL")
def discretised(spark, sf_dir):
    """Each value's chunk, the last one that holds it."""
    cells = long(spark, sf_dir)
    return frames.discretised(cells, frames.equal_frequency(cells)).select("row_id", "feature_id", "bin")


@register("interval_members", _BINS + """, d AS (SELECT l.row_id, l.feature_id, value, max(bin) AS bin FROM l JOIN b ON l.feature_id = b.feature_id AND value BETWEEN lo AND hi GROUP BY ALL)
SELECT feature_id, bin, round(value, 6) AS value, row_id, row_number() OVER (PARTITION BY feature_id, bin ORDER BY value, row_id) - 1 AS place FROM d""")  # fmt: skip
def interval_members(spark, sf_dir):
    """What stands behind each chunk, in order."""
    cells = long(spark, sf_dir)
    d = frames.discretised(cells, frames.equal_frequency(cells))
    return frames.interval_members(d).select("feature_id", "bin", F.round("value", 6).alias("value"), "row_id", "place")


@register("chunked_list", f"WITH {MATRIX} SELECT user_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY row_id) - 1) / 16) AS BIGINT) AS chunk, row_id FROM m")
def chunked_list(spark, sf_dir):
    """A key's rows in groups of 16, by their places."""
    rows = order.placed(matrix(spark, sf_dir).select("user_id", "row_id"), "user_id", ["row_id"])
    return rows.select("user_id", F.floor(F.col("place") / 16).alias("chunk"), "row_id")


_MAPS = "WITH s AS (SELECT user_id, event_type AS k, sum(value) AS v FROM events GROUP BY ALL)"


@register("sparse_shared_keys", _MAPS + " SELECT a.user_id, a.k, round(a.v * b.v, 4) AS product FROM s a JOIN s b ON a.k = b.k AND b.user_id = a.user_id + 1")
def sparse_shared_keys(spark, sf_dir):
    """Keys that two neighbours' sparse vectors share."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.sum("value").alias("v"))
    nxt = s.select((F.col("user_id") - 1).alias("user_id"), "k", F.col("v").alias("v2"))
    return s.join(nxt, ["user_id", "k"]).select("user_id", "k", F.round(F.col("v") * F.col("v2"), 4).alias("product"))


@register("sparse_extra_keys", _MAPS + " SELECT user_id, k, round(v, 4) AS v FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.user_id = s.user_id + 1 AND b.k = s.k)")
def sparse_extra_keys(spark, sf_dir):
    """Keys that the neighbour lacks."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.sum("value").alias("v"))
    return s.join(s.select((F.col("user_id") - 1).alias("user_id"), "k"), ["user_id", "k"], "left_anti").select("user_id", "k", F.round("v", 4).alias("v"))


@register("sparse_to_dense", _MAPS + " SELECT user_id, round(coalesce(sum(v) FILTER (WHERE k = 'purchase'), 0), 4) AS purchase, round(coalesce(sum(v) FILTER (WHERE k = 'signup'), 0), 4) AS signup FROM s GROUP BY user_id")
def sparse_to_dense(spark, sf_dir):
    """Chosen keys of sparse vectors as columns, missing ones 0."""
    s = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["purchase", "signup"]).agg(F.sum("value"))
    return s.select("user_id", *(F.round(F.coalesce(k, F.lit(0.0)), 4).alias(k) for k in ("purchase", "signup")))


@register("labelled_split", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def labelled_split(spark, sf_dir):
    """Documents with a label, and the others, together again."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_semi").withColumn("labelled", F.lit(True)).unionByName(d.join(lab, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@register("masked_cells", f"WITH {MASKED} SELECT feature_id, count(value) AS seen, count(*) AS cells FROM k GROUP BY feature_id")
def masked_cells(spark, sf_dir):
    """The missingness that the other queries work on."""
    return masked_long(spark, sf_dir).groupBy("feature_id").agg(F.count("value").alias("seen"), F.count("*").alias("cells"))
