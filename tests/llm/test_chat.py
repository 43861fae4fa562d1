import itertools

import numpy as np
import pytest

from pyspark.sql import functions as F

from textkin.llm import chat, queries

TURNS = [(c, t, r, [f"{m}: {x}"] + more) for c in range(12) for t, (r, m, x, more) in enumerate([
    ("system", "Rules", "be kind", []), ("user", "Q", "what is it?", []), ("assistant", "A", "it is a long story", ["that goes on", "and on."]),
    ("user", "Q", "why?", []), ("assistant", "A", "because", ["it does."])])]


def model(spark):
    return chat.fit(spark.createDataFrame(TURNS, "conv long, turn long, role string, lines array<string>"))


def lines(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv long, major long, minor long, line string, role string")


def test_roles_and_rendering(spark):
    text = ["Q: so?", "A: yes", "indeed.", "Q: and?", "A: no."]
    got = chat.recover_roles(lines(spark, [(7, i, 0, x) for i, x in enumerate(text)]), model(spark))
    turns = [tuple(r) for r in chat.render(got).orderBy("turn").collect()]
    assert turns == [(7, 0, "user", 1, "<|user|>\nso?\n<|end|>"), (7, 1, "assistant", 2, "<|assistant|>\nyes\nindeed.\n<|end|>"),
                     (7, 2, "user", 1, "<|user|>\nand?\n<|end|>"), (7, 3, "assistant", 1, "<|assistant|>\nno.\n<|end|>")]


def test_decoding_is_the_best_path(spark):
    m = model(spark)
    text = ["Q: hm", "x.", "A: y?", "z"]
    steps = m.steps(text)
    best = max(itertools.product(range(len(m.start)), repeat=4),
               key=lambda p: m.start[p[0]] + sum(m.move[a, b] for a, b in zip(p, p[1:])) + sum(steps[i][s] for i, s in enumerate(p)))
    assert chat.decode(m, steps) == list(best)
    whole = chat.product(m, steps)
    parts = chat.chain([chat.product(m, steps[:1]), chat.product(m, steps[1:3]), chat.product(m, steps[3:])])
    assert np.allclose(whole, parts)


@pytest.mark.parametrize("segment,fan", [(1, 2), (3, 2)])
def test_segments_decode_like_the_whole(spark, segment, fan):
    m = model(spark)
    rows = [(c, t, i, x) for c, t, _, own in TURNS[:25] for i, x in enumerate(own)]
    rows += [(99, k, 0, ["Q: a", "", "b.", "A: c", "plain words here", "Q d"][k * k % 6]) for k in range(23)]
    df = lines(spark, rows)
    key = lambda r: (r.conv, r.major, r.minor)
    whole = sorted(chat.recover_roles(df, m, segment=1000).collect(), key=key)
    assert sorted(chat.recover_roles(df, m, segment=segment, fan=fan).collect(), key=key) == whole
    assert max(r.turn for r in whole if r.conv == 99) > 3


def test_edges(spark):
    m = model(spark)
    got = chat.recover_roles(lines(spark, [(None, 1, 0, "Q: a"), (1, None, 0, "Q: a"), (2, 0, None, None), (2, 0, 0, ""), (3, 0, 0, "word " * 200_000)]), m).collect()
    assert len(got) == 5 and {r.role for r in got if r.conv is None or r.major is None} == {None}
    assert all(r.role for r in got if r.conv in (2, 3))
    assert chat.recover_roles(lines(spark, []), m).collect() == []
    unknown = chat.fit(spark.createDataFrame([], "conv long, turn long, role string, lines array<string>"))
    assert [r.role for r in chat.recover_roles(lines(spark, [(1, 0, 0, "Q: a")]), unknown).collect()] == [None]


def test_markers():
    assert [chat.marker_of(x)[0] for x in ("User: a", "<|bot|> b", "### Reply", "[Q] c", "plain", "http://x", "")] == ["user", "bot", "reply", "q", "", "http", ""]


def test_held_out_roles(spark):
    sf = "/root/testdata/sf0.01"
    truth = queries.raw_turns(spark, sf).select(F.col("conv").alias("c"), "turn", F.col("role").alias("true"))
    got = queries.recovered_lines(spark, sf).drop("turn")
    both = got.join(truth, (F.col("conv") == F.col("c")) & (F.col("major") == F.col("turn"))).where(F.crc32(F.col("conv").cast("string")) % 4 == 2)
    assert both.agg(F.avg((F.col("role") == F.col("true")).cast("int"))).first()[0] > 0.85


def test_rows_without_transcript_or_major_are_rendered_one_by_one(spark):
    rows = [(None, 1, 0, "Q: a"), (None, 1, 0, "Q: a"), (None, None, 0, "b"), (1, None, 0, "Q: c"), (1, None, 1, "d"), (1, 0, 0, "Rules: e"), (None, 2, 0, None)]
    got = chat.render(chat.recover_roles(lines(spark, rows), model(spark)))
    assert got.columns == ["conv", "turn", "role", "n_lines", "rendered"]
    one = lambda x: f"<|unknown|>\n{x}\n<|end|>"
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(
        [(c, 0, None, 1, one(x)) for c, x in [(None, "a"), (None, "a"), (None, "b"), (None, ""), (1, "c"), (1, "d")]]
        + [(1, 0, "system", 1, "<|system|>\ne\n<|end|>")], got.schema).collect()))


def test_more_roles_than_are_told_apart(spark):
    rows = [(c, 0, f"role{c:03}", [f"r{c}: hello"]) for c in range(205)] + [(c, 1, "user", ["Q: a"]) for c in range(205)]
    m = chat.fit(spark.createDataFrame(rows, "conv long, turn long, role string, lines array<string>"))
    assert len(m.roles) == 201 and "user" in m.roles and chat.RARE in m.roles and m.move.shape == (402, 402)


def test_turns_that_many_rows_repeat(spark):
    once = [(1, 0, "user", ["Q: a"]), (1, 1, "assistant", ["A: b", "c"]), (1, 2, "user", ["Q: d"])]
    rows = spark.createDataFrame([r for r in once for _ in range(1000)], "conv long, turn long, role string, lines array<string>")
    m = chat.fit(rows.withColumn("last", F.lit("x")).withColumn("blank", F.lit(1)).withColumn("x", F.lit(2)))
    want = chat.fit(spark.createDataFrame(once, rows.schema))
    # Counts are a thousandfold: (1000 + smoothing) of (1000 + 4 * smoothing) moves from the end of an assistant's turn to the user.
    assert m.roles == want.roles and np.isclose(np.exp(m.move[1, 2]), 1000.5 / 1002) and np.isclose(np.exp(want.move[1, 2]), 1.5 / 3)
    assert chat.decode(m, m.steps(["Q: x", "A: y"])) == chat.decode(want, want.steps(["Q: x", "A: y"]))
