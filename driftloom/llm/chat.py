"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

Lines of a transcript show their speaker by markers ("User:", "### Assistant", "<|system|>"), or
not at all. The hidden states are (role, first line of a turn or a later one); a line's features
are its marker, whether it asks, and how long it is. The probabilities are counted on lines whose
roles are known (:func:`fitted`), or set by hand where there are none. Viterbi finds the likeliest states of the
whole transcript. A max-plus product of transition steps is associative, so that long transcripts
are cut into blocks: each block is reduced to one small matrix, the matrices of a transcript fix
the states at the blocks' borders, and each block then finds its own path between them. No
transcript is ever gathered in one task, only one matrix for each of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators.order import placed

ROLES = ("system", "user", "assistant")
#: Lines of a block.
BLOCK = 512
# Speaker markers at the start of a line, with optional signs around them.
MARKERS = {
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "question", "customer", "q", "me"],
    "assistant": ["assistant", "ai", "bot", "answer", "agent", "a", "gpt"],
}
_SHAPE = r"(?i)^\s*(?:<\|\s*({0})\s*\|>:?|\[\s*({0})\s*\]:?|#+\s*({0})\s*(?::|$)|\**\s*({0})\s*\**\s*:\**|({0})>)\s*"
MARKER = _SHAPE.format("|".join(sorted((m for ms in MARKERS.values() for m in ms), key=lambda m: (-len(m), m))))
LENGTHS = (60, 200, 600)

_N = 2 * len(ROLES)  # states: first lines of each role, then later lines of each
_BAD = -1e6


class Model(NamedTuple):
    """Log-probabilities: start, transition, marker (none or a role) by state, question (no, yes) and length by state."""

    start: np.ndarray
    move: np.ndarray
    mark: np.ndarray
    form: np.ndarray


def _logs(start: np.ndarray, move: np.ndarray, marker: np.ndarray, ask: np.ndarray, size: np.ndarray) -> Model:
    log = lambda x: np.log(np.maximum(x, 1e-12))
    both = np.concatenate((log(ask), log(size)), axis=1)
    return Model(log(start), log(move), log(marker), np.concatenate((both, both)))


def _moves(to_role: np.ndarray, on: np.ndarray) -> np.ndarray:
    """A turn goes on with probability ``on`` by role, or the next one opens by ``to_role``."""
    move = np.zeros((_N, _N))
    for i in range(_N):
        role = i % 3
        move[i, :3] = (1 - on[role]) * to_role[role]
        move[i, 3 + role] = on[role]
    return move


def by_hand() -> Model:
    """A marker nearly always tells the role, speakers nearly always alternate, a system turn comes first if at all, users ask more and write less."""
    start = np.full(_N, 1e-6)
    start[:3] = (0.3, 0.6, 0.1)
    to_role = np.array([[0.001, 0.909, 0.09], [0.002, 0.048, 0.95], [0.002, 0.95, 0.048]])
    marker = np.full((_N, 4), 0.002)
    for role in range(3):
        marker[role, 0], marker[role, 1 + role] = 0.2, 0.796
        marker[3 + role, 0], marker[3 + role, 1 + role] = 0.992, 0.004
    ask = np.array([[0.97, 0.03], [0.7, 0.3], [0.9, 0.1]])
    size = np.array([[0.4, 0.4, 0.15, 0.05], [0.3, 0.45, 0.2, 0.05], [0.15, 0.3, 0.35, 0.2]])
    return _logs(start, _moves(to_role, np.full(3, 0.55)), marker, ask, size)


BY_HAND = by_hand()


def marker_of(line: Column) -> Column:
    """0: none; 1, 2, 3: the line begins with a marker of that role."""
    name = F.lower(F.concat_ws("", *(F.regexp_extract(line, MARKER, i) for i in range(1, 6))))
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(name.isin(*MARKERS[role]), i + 1).otherwise(out)
    return out


def without_marker(line: Column) -> Column:
    return F.when(marker_of(line) > 0, F.regexp_replace(line, MARKER, "")).otherwise(line)


def _steps(pdf: pd.DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each line's emission, and whether it opens its transcript."""
    e = model.mark[:, pdf["marker"]].T + model.form[:, pdf["asks"]].T + model.form[:, 2 + pdf["size"]].T
    return e, (pdf["line"] == 0).to_numpy()


def _reduce(e: np.ndarray, opens: np.ndarray, model: Model = BY_HAND) -> np.ndarray:
    """Max-plus product of the steps: best score from each state before the block to each at its end."""
    m = None
    for x, first in zip(e, opens, strict=True):
        step = np.broadcast_to(model.start, (_N, _N)) + x if first else model.move + x
        m = step if m is None else (m[:, :, None] + step[None]).max(1)
    return m


def _path(e: np.ndarray, opens: np.ndarray, before: int, after: int, model: Model = BY_HAND) -> np.ndarray:
    """The best states of the block's lines, from the state before it to its last one."""
    score, back = np.full(_N, _BAD * 10), np.zeros((len(e), _N), np.int64)
    score[before] = 0
    for t, (x, first) in enumerate(zip(e, opens, strict=True)):
        step = (np.broadcast_to(model.start, (_N, _N)) if first else model.move) + score[:, None]
        back[t] = step.argmax(0)
        score = step.max(0) + x
    out, state = np.zeros(len(e), np.int64), after
    for t in range(len(e) - 1, -1, -1):
        out[t] = state
        state = back[t, state]
    return out


def _runs(pdfs: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows with equal keys from batches sorted by them; a run may span batches."""
    held = None
    for pdf in pdfs:
        pdf = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
        if len(pdf):
            change = np.zeros(len(pdf) - 1, bool)
            for k in keys:
                v = pdf[k].to_numpy()
                change |= v[1:] != v[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            for x, z in zip(cuts, cuts[1:], strict=False):
                yield pdf.iloc[x:z]
            held = pdf.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held


def _gathered(parts: Iterator[tuple], names: list[str], rows: int = 5000) -> Iterator[pd.DataFrame]:
    """Frames of about ``rows`` rows from tuples of equally long sequences."""
    held, n = [], 0
    frame = lambda: pd.DataFrame({name: [x for part in held for x in part[i]] for i, name in enumerate(names)})
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield frame()
            held, n = [], 0
    if held:
        yield frame()


def _matrices(model: Model):
    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (((g["t"].iloc[0],), (g["block"].iloc[0],), (_reduce(*_steps(g, model), model).ravel().tolist(),)) for g in _runs(pdfs, ["t", "block"]))
        yield from _gathered(found, ["t", "block", "m"])

    return work


def _border(g: pd.DataFrame) -> tuple:
    """From a transcript's block matrices in order, the states before and at the end of each block."""
    score, back = np.zeros(_N), []
    for m in g["m"]:
        step = np.asarray(m).reshape(_N, _N) + score[:, None]
        back.append(step.argmax(0))
        score = step.max(0)
    state, before, after = int(score.argmax()), [], []
    for b in reversed(back):
        after.append(state)
        state = int(b[state])
        before.append(state)
    return g["t"].tolist(), g["block"].tolist(), before[::-1], after[::-1]


def _borders(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _gathered(map(_border, _runs(pdfs, ["t"])), ["t", "block", "before", "after"])


def _states(model: Model):
    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = lambda g: _path(*_steps(g, model), int(g["before"].iloc[0]), int(g["after"].iloc[0]), model).tolist()
        yield from _gathered(((g["t"].tolist(), g["line"].tolist(), path(g)) for g in _runs(pdfs, ["t", "block"])), ["t", "line", "state"])

    return work


def _featured(lines: DataFrame, transcript: str, order: str, text: str, carry: Sequence[str]) -> DataFrame:
    """(t, at, x, carry.…, line, block, marker, asks, size): lines numbered within their transcripts, by ranges, and their features."""
    named = lines.select(
        F.col(transcript).alias("t"), F.col(order).cast("long").alias("at"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("carry")
    )
    named = placed(named.where("t is not null and at is not null"), "t", ["at", "x"]).withColumnRenamed("place", "line")
    size = sum((F.length("x") >= n).cast("int") for n in LENGTHS)
    return named.select(
        "t", "at", "x", "carry", "line", F.floor(F.col("line") / BLOCK).alias("block"),
        marker_of(F.col("x")).alias("marker"), F.col("x").rlike(r"\?\s*$").cast("int").alias("asks"), size.alias("size"),
    )


def fitted(lines: DataFrame, transcript: str, order: str, text: str, role: str, opens: str) -> Model:
    """The model counted on lines whose role and turn starts are known, each count one more than seen.

    Counts over all given lines, added up by the cluster: the driver sees at most a row for each
    pair of states and feature. Lines of other roles are left out.
    """
    named = _featured(lines, transcript, order, text, [role, opens]).select("t", "line", "marker", "asks", "size", F.array_position(F.array(*map(F.lit, ROLES)), F.col("carry")[role]).alias("r"), F.col("carry")[opens].alias("o"))
    named = named.where("r > 0").select("t", "line", "marker", "asks", "size", (F.col("r") - 1).cast("int").alias("r"), F.when(F.col("o"), 0).otherwise(1).alias("later"))
    after = named.select("t", (F.col("line") + 1).alias("line"), F.col("r").alias("was"))
    seen = named.join(after, ["t", "line"], "left").groupBy("was", "r", "later", "marker", "asks", "size").agg(F.count("*").alias("n"), F.count_if(F.col("line") == 0).alias("first"))
    start, to_role, on, marker, ask, size = np.full(_N, 1e-6), np.ones((3, 3)), np.ones((3, 2)), np.ones((_N, 4)), np.ones((3, 2)), np.ones((3, 1 + len(LENGTHS)))
    start[:3] = 1
    for x in seen.collect():
        marker[x.r + 3 * x.later, x.marker] += x.n
        ask[x.r, x.asks] += x.n
        size[x.r, x["size"]] += x.n
        if x.was is None:
            start[x.r] += x["first"]
        else:
            on[x.was, x.later] += x.n
            if not x.later:
                to_role[x.was, x.r] += x.n
    share = lambda a: a / a.sum(-1, keepdims=True)
    return _logs(share(start), _moves(share(to_role), share(on)[:, 1]), share(marker), share(ask), share(size))


def line_roles(lines: DataFrame, transcript: str, order: str, text: str, carry: Sequence[str] = (), model: Model = BY_HAND) -> DataFrame:
    """(transcript, order, text, …carry, found_role, opens, chat_line_no) for each line: its role, and whether it opens a turn.

    ``order`` are whole numbers that need not be dense; repeated ones keep both lines, in the order
    of their texts. Columns of ``lines`` to be kept are named by ``carry``. Null text is an empty
    line. Lines without transcript or order are left out. Only the three roles of :data:`ROLES`
    can be found. Transcripts of any length are handled in blocks of lines.
    """
    named = _featured(lines, transcript, order, text, carry)
    kind = named.schema["t"].dataType.simpleString()
    seen = named.select("t", "block", "line", "marker", "asks", "size")
    dealt = seen.repartition("t", "block").sortWithinPartitions("t", "block", "line")
    matrices = dealt.mapInPandas(_matrices(model), f"t {kind}, block long, m array<double>")
    borders = matrices.repartition("t").sortWithinPartitions("t", "block").mapInPandas(_borders, f"t {kind}, block long, before int, after int")
    again = seen.join(borders, ["t", "block"]).repartition("t", "block").sortWithinPartitions("t", "block", "line")
    states = again.mapInPandas(_states(model), f"t {kind}, line long, state int")
    role = F.get(F.array(*map(F.lit, ROLES)), F.col("state") % 3)
    return named.join(states, ["t", "line"]).select(
        F.col("t").alias(transcript), F.col("at").alias(order), F.col("x").alias(text), *(F.col("carry")[c].alias(c) for c in carry),
        role.alias("found_role"), (F.col("state") < 3).alias("opens"), F.col("line").alias("chat_line_no"),
    )


def render(role: Column, body: Column) -> Column:
    """A turn in the canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(body), F.lit("\n<|end|>\n"))


def format_lines(lines: DataFrame, transcript: str, order: str, text: str, carry: Sequence[str] = (), model: Model = BY_HAND) -> DataFrame:
    """:func:`line_roles` with each line's share of the canonical rendering.

    The rendered shares of a transcript, in order, joined by nothing, are the canonical text: the
    line that opens a turn brings its header (and closes the turn before), and loses its marker.
    An empty table gives an empty result.
    """
    roles = line_roles(lines, transcript, order, text, carry, model)
    body = F.when(F.col("opens"), without_marker(F.col(text))).otherwise(F.col(text))
    head = F.when(F.col("opens"), F.concat(F.when(F.col("chat_line_no") > 0, F.lit("<|end|>\n")).otherwise(F.lit("")), F.lit("<|"), F.col("found_role"), F.lit("|>\n"))).otherwise(F.lit(""))
    return roles.withColumn("rendered", F.concat(head, body, F.lit("\n"))).drop("chat_line_no")
