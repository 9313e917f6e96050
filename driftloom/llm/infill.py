"""Fill-in-middle transformation: DuckDB runs inside each task over Arrow batches.

Every batch is registered with a DuckDB connection of the task, and one SQL statement cuts the
texts into units (``regexp_extract_all``), takes prefix, middle and suffix (``list_slice``,
``array_to_string``) at two cuts that a SHA-256 of seed and id draws, and puts them together with
sentinels. The result goes back as Arrow; no row passes through Python. ``restored`` is the inverse,
again by SQL, from the output and the form alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from driftloom.llm.shared import slices

#: Lines with their line end; the last one may have none.
LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Style:
    """How texts are cut and put together.

    ``rate`` percent of the texts are transformed, ``spm`` percent of those with the suffix first.
    Sentinels are told apart from any text around them: none may hold another, nor end as one begins.
    """

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    units: str = LINES

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        if len(set(marks)) < 3:
            raise ValueError("sentinels must differ")
        for a in marks:
            for b in marks:
                meets = any(a.endswith(b[:i]) for i in range(1, len(b)))
                if not a or meets or (a is not b and b in a):
                    raise ValueError(f"sentinels {a!r} and {b!r} cannot be told apart")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _connection() -> duckdb.DuckDBPyConnection:
    """One thread and no files: Spark gives the task its core and its share of the memory."""
    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True, "autoinstall_known_extensions": False})


def _cut_sql(style: Style) -> str:
    p, s, m = _text(style.prefix), _text(style.suffix), _text(style.middle)
    part = lambda a, b: f"coalesce(array_to_string(list_slice(u, {a}, {b}), ''), '')"
    word = lambda i: f"('0x' || h[{8 * i + 1}:{8 * i + 8}])::BIGINT"
    return f"""
WITH t AS (SELECT whole, coalesce(text, '') AS text, sha256('{style.seed}:' || coalesce(id, '')) AS h FROM texts_batch),
u AS (SELECT whole, text, regexp_extract_all(text, {_text(style.units)}) AS u, {", ".join(f"{word(i)} AS h{i + 1}" for i in range(4))} FROM t),
c AS (SELECT whole, text, u, len(u) AS n, h1 % (len(u) + 1) AS a, h2 % (len(u) + 1) AS b,
  CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {style.rate} THEN 'plain' WHEN h4 % 100 < {style.spm} THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT whole, text, n, form, CASE WHEN form <> 'plain' THEN {part(1, "least(a, b)")} END AS prefix,
  CASE WHEN form <> 'plain' THEN {part("least(a, b) + 1", "greatest(a, b)")} END AS middle, CASE WHEN form <> 'plain' THEN {part("greatest(a, b) + 1", "n")} END AS suffix FROM c)
SELECT whole, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'spm' THEN concat({s}, suffix, {p}, prefix, {m}, middle) ELSE concat({p}, prefix, {s}, suffix, {m}, middle) END AS output FROM x"""


def _restore_sql(style: Style) -> str:
    marks = _text("|".join(re.escape(m) for m in (style.prefix, style.suffix, style.middle)))
    return f"""
SELECT whole, CASE form WHEN 'plain' THEN output WHEN 'spm' THEN array_to_string([s[3], s[4], s[2]], '') ELSE array_to_string([s[2], s[4], s[3]], '') END AS restored
FROM (SELECT whole, output, form, CASE WHEN form <> 'plain' THEN string_split_regex(output, {marks}) END AS s FROM texts_batch)"""


def _through(df: DataFrame, sql: str, text: int, added: list[StructField]) -> DataFrame:
    """``sql`` over the batches of ``df``, whose first column ``whole`` it hands on; batches hold about 2 MB of text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for batch in batches:
            for part in slices(batch, text):
                # what SQL does not look at stays with its row's place
                seen = pa.Table.from_batches([part]).set_column(0, "whole", pa.array(range(part.num_rows), pa.int64()))
                con.register("texts_batch", seen)
                got = con.sql(sql).to_arrow_table()
                con.unregister("texts_batch")
                whole = pa.table({"whole": part.column(0)}).take(got.column("whole"))
                yield from got.set_column(0, "whole", whole.column(0)).to_batches()

    return df.mapInArrow(task, StructType([df.schema["whole"], *added]))


def infilled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", style: Style = Style()) -> DataFrame:
    """One row per input row: id, n, form, prefix_chars, middle_chars, output.

    The text's n units (lines, by default) are cut after the smaller and after the larger of two
    drawn places; ``form`` is psm, spm or plain. Plain are empty texts, texts that hold a sentinel
    and those that the rate leaves out; their output is the text, and their lengths are null. Null
    text is empty, a null id is drawn as an empty one. Equal rows are cut alike. An empty table gives
    no rows; other columns play no part. A text of any length is one row of one batch.
    """
    slim = docs.select(F.struct(F.col(doc_id).alias("id")).alias("whole"), F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    out = _through(slim, _cut_sql(style), 2, [StructField("n", LongType()), StructField("form", StringType()), *(StructField(c, LongType()) for c in ("prefix_chars", "middle_chars")), StructField("output", StringType())])
    return out.select(F.col("whole.id").alias(doc_id), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(outputs: DataFrame, style: Style = Style()) -> DataFrame:
    """``outputs`` (of :func:`infilled`, any other columns too) with ``restored``, the exact text before; null output gives null."""
    slim = outputs.select(F.struct(*(outputs[f"`{c}`"] for c in outputs.columns)).alias("whole"), "form", "output")
    out = _through(slim, _restore_sql(style), 2, [StructField("restored", StringType())])
    return out.select(*(F.col("whole")[c].alias(c) for c in outputs.columns), "restored")
