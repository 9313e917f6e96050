import itertools

import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import chat, queries


def best_by_trying(e):
    def score(path):
        s = chat.BY_HAND.start[path[0]] + e[0][path[0]]
        return s + sum(chat.BY_HAND.move[a, b] + e[t + 1][b] for t, (a, b) in enumerate(itertools.pairwise(path)))

    return max(itertools.product(range(6), repeat=len(e)), key=score)


def test_blocks_find_the_best_path():
    r = np.random.default_rng(4)
    for _ in range(10):
        e, opens = r.standard_normal((5, 6)) * 3, np.array([True] + [False] * 4)
        whole = chat._reduce(e, opens)
        parts = [chat._reduce(e[:2], opens[:2]), chat._reduce(e[2:], opens[2:])]
        assert np.allclose(whole, (parts[0][:, :, None] + parts[1][None]).max(1))
        end = int(whole[0].argmax())
        assert tuple(chat._path(e, opens, 0, end)) == best_by_trying(e)


def lines_of(spark, transcripts):
    rows = [(t, i, x, "r", 1) for t, xs in transcripts.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "id string, no long, body string, role string, block int")


def test_markers_and_rendering(spark):
    talk = {
        "a": ["System: be kind", "User: Hi there?", "more of it", "### Assistant", "Hello.", "<|user|> Bye", "[Bot]: Bye."],
        "b": ["Human: what is the time?", "It is noon, as far as I can tell from here, and it will be one in an hour." * 4, "AI> wait"],
        "c": ["", None],
        "d": ["x" * 200_000],
    }
    out = chat.format_lines(lines_of(spark, talk), "id", "no", "body").orderBy("id", "no").collect()
    roles = {k: [r.found_role for r in out if r.id == k] for k in talk}
    assert roles["a"] == ["system", "user", "user", "assistant", "assistant", "user", "assistant"]
    assert roles["b"][0] == "user" and roles["b"][2] == "assistant"
    text = "".join(r.rendered for r in out if r.id == "a")
    assert text == "<|system|>\nbe kind\n<|end|>\n<|user|>\nHi there?\nmore of it\n<|end|>\n<|assistant|>\n\nHello.\n<|end|>\n<|user|>\nBye\n<|end|>\n<|assistant|>\nBye.\n"
    assert len(out) == sum(map(len, talk.values()))


def test_long_transcript_in_blocks(spark, monkeypatch):
    talk = {"long": [f"{'User' if i % 2 == 0 else 'Assistant'}: line {i}" if i % 5 else f"plain {i}" for i in range(3000)]}
    df = lines_of(spark, talk)
    many = [r.found_role for r in chat.line_roles(df, "id", "no", "body").orderBy("no").collect()]
    monkeypatch.setattr(chat, "BLOCK", 10_000)
    assert many == [r.found_role for r in chat.line_roles(df, "id", "no", "body").orderBy("no").collect()]


def test_empty(spark):
    assert chat.format_lines(spark.createDataFrame([], "id long, no long, body string"), "id", "no", "body").count() == 0


def test_recovers_roles_of_the_table(spark):
    out = queries.op2_chat_format(spark, "/root/testdata/sf0.01").where("opens_turn")
    right = out.agg(F.avg((F.col("role") == F.col("found_role")).cast("double"))).first()[0]
    assert right > 0.93


def test_whole_query_finds_likeliest_paths(spark):
    """Every transcript of a table against a plain Viterbi over all its lines, with the model the query counts."""
    sf = "/root/testdata/sf0.01"
    cells = queries._transcripts(spark, sf)
    model = chat.fitted(cells.where(F.crc32(F.col("conv_id").cast("string")) % 7 == 2), "conv_id", "place", "line", "role", "opens_turn")
    assert all(np.allclose(np.exp(m).sum(-1), 1, atol=1e-3) for m in (model.start, model.move, model.mark, model.form[:, :2], model.form[:, 2:]))
    feature = {(r.conv_id, r.place): r for r in cells.select("conv_id", "place", chat.marker_of(F.col("line")).alias("m"), F.col("line").rlike(r"\?\s*$").cast("int").alias("a"), F.length("line").alias("n")).collect()}
    found = {}
    for r in queries.op2_chat_format(spark, sf).collect():
        state = chat.ROLES.index(r.found_role) + (0 if r.opens_found_turn else 3)
        found.setdefault(r.conv_id, []).append(((r.turn << 31) + r.part, state))
    assert sum(map(len, found.values())) == len(feature) == cells.count()
    for conv, states in found.items():
        states.sort()
        e = []
        for place, _ in states:
            x = feature[conv, place]
            e.append(model.mark[:, x.m] + model.form[:, x.a] + model.form[:, 2 + sum(x.n >= k for k in chat.LENGTHS)])
        best = model.start + e[0]
        for step in e[1:]:
            best = (best[:, None] + model.move).max(0) + step
        mine = model.start[states[0][1]] + e[0][states[0][1]]
        for (_, a), (_, b), step in zip(states, states[1:], e[1:]):
            mine += model.move[a, b] + step[b]
        assert np.isclose(mine, best.max())


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, 0, "User: a", "x", 1), (1, 0, "User: a", "x", 1), (1, 1, "Bot: b", "y", 2), (None, 1, "Bot: b", "y", 2)]
    df = spark.createDataFrame(rows, "id long, no long, body string, line string, opens int")
    out = chat.format_lines(df, "id", "no", "body", ["line"]).collect()
    assert sorted((r.no, r.line, r.found_role) for r in out) == [(0, "x", "user"), (0, "x", "user"), (1, "y", "assistant")]
