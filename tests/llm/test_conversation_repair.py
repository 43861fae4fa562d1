import hashlib
from itertools import product

import numpy as np
import pytest
from textkin.llm import queries
from textkin.llm.conversation_repair import Grammar, faults, learn, repair, segments, summarise, whole

SCHEMA = "conv_id long, turn long, role string, text string, conv string, seg int, cost string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def marked(rows):
    """Rows in order with their first fault."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    out, seen = [], set()
    for t, r, x in rows:
        ink = x.strip(" \t\n\x0b\x0c\r")
        out.append((t, r, x, "b" if not ink else "d" if (r, x) in seen else "t" if ink[-1] not in ".!?" else "-"))
        seen.add((r, x))
    return out


def paths(rows, state="", at=0, spare=2):
    """Every ``(cost, edits, lines)`` of at most two inserts in a row that leaves legal turns."""
    if at == len(rows) and state in ("", "a"):
        yield 0, "", []
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
    if spare:
        for c, e, x in paths(rows, follow, at, spare - 1):
            yield c + 2, "I" + e, [FULL[follow] + ":"] + x
    if at < len(rows):
        _, role, text, fault = rows[at]
        for c, e, x in paths(rows, state, at + 1):
            yield c + 3, "D" + e, x
        if fault in "t-":
            extra = fault == "t"
            if (state, role[:1]) in NEXT:
                for c, e, x in paths(rows, NEXT[state, role[:1]], at + 1):
                    yield c + extra, "K" + e, [f"{role}:{text}"] + x
            for c, e, x in paths(rows, follow, at + 1):
                yield c + 2 + extra, "R" + e, [f"{FULL[follow]}:{text}"] + x


def table(rows, best):
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, edits, lines = best
    return [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(r[3] == f for r in rows) for f in "bdt"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()]


def run(spark, rows, ids, **kw):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    out = summarise(repair(df, **kw), spark.createDataFrame([(i,) for i in ids], "conv_id long"))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: list(r[1:]) for r in got}


@pytest.fixture(scope="module")
def short():
    rng = np.random.default_rng(2)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "cut", " \t", None, "Ö? \n", "x.\x0b"]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.integers(1, 6)):
            turn = [None, 0, 1, 2, 5, 9][rng.integers(6)]
            rows.append((conv, turn, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    want = {}
    for conv in [None, *range(60)]:
        own = marked([r[1:] for r in rows if r[0] == conv])
        want[conv] = table(own, min(paths(own), key=lambda p: p[:2]))
    return rows, want


@pytest.mark.parametrize("size", [1, 2, 1024])
def test_against_all_edits(spark, short, size):
    rows, want = short
    assert run(spark, rows, [*want, 0, None], size=size) == want


def stepwise(rows):
    """The same rule row by row, for conversations too long for all edits."""
    ends = {"": (0, "", ())}

    def inserted(ends):
        out = dict(ends)
        for _ in range(2):
            for s, (c, e, x) in list(out.items()):
                to = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                new = (c + 2, e + "I", x + (FULL[to] + ":",))
                out[to] = min(out.get(to, new), new)
        return out

    for _, role, text, fault in rows:
        new = {}
        for s, (c, e, x) in inserted(ends).items():
            follow = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
            options = [(s, (c + 3, e + "D", x))]
            if fault in "t-":
                extra = int(fault == "t")
                options.append((follow, (c + 2 + extra, e + "R", x + (f"{FULL[follow]}:{text}",))))
                if (s, role[:1]) in NEXT:
                    options.append((NEXT[s, role[:1]], (c + extra, e + "K", x + (f"{role}:{text}",))))
            for to, o in options:
                new[to] = min(new.get(to, o), o)
        ends = new
    ends = inserted(ends)
    return min(ends[s] for s in ("", "a") if s in ends)


def test_long_conversations_in_segments(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i, ["user", "assistant"][i % 2 if rng.random() < .9 else 0], ["Same.", f"t{i}.", f"cut {i}", ""][rng.choice(4, p=[.05, .8, .1, .05])])
            for i in range(1500)]
    rows += [(2, None, "user", "Equal.")] * 700 + [(3, i, "assistant", "a b." * 40_000) for i in range(3)]
    want = {}
    for conv in (1, 2, 3):
        own = marked([r[1:] for r in rows if r[0] == conv])
        want[conv] = table(own, stepwise(own))
    got = run(spark, rows, [1, 2, 3], size=64)
    assert got == want and got[2][:6] == [0, 0, 699, 0, 699, 699 * 3 + 2]


def test_edges(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, [], []) == {}
    assert run(spark, [], [7, 7]) == {7: [0, 0, 0, 0, 0, 0, "", empty]}
    got = run(spark, [(1, 3, "user", ""), (2, 0, "system", "Only."), (3, 4, "user", "Hi."), (3, 6, "assistant", "Ho.")], [1, 2, 3])
    assert got[1] == [0, 1, 0, 0, 0, 3, "D", empty] and got[2][5:7] == [3, "D"] and got[3][:7] == [1, 0, 0, 0, 0, 0, "KK"]


def test_rules_are_shared_and_change_nothing(spark):
    rows = [(c, i, ["user", "assistant"][i % 2], f"t{i}" + "." * (i % 3)) for c in range(20) for i in range(12)]
    found = segments(faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    grammar, plain = learn(found), Grammar([])
    symbols = {r.symbols for r in found.collect()}
    assert len(symbols) == 1 and len(grammar.rules) > 2
    for s in symbols | {"uauauaua", "xxUAsuo", ""}:
        assert len(grammar.compress(s)) <= len(s) and whole(grammar, s) == whole(plain, s)
    assert max(len(grammar.compress(s)) for s in symbols) < 6


def test_damage_of_the_query(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in range(20)] + [(None, None, None, None)]
    got = queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    import zlib
    for c, t, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = [r for r in got if (r.conv_id, r.turn) == (c, t)]
        assert len(own) == {0: 0, 3: 2}.get(kind, 1)
        if own and c is not None:
            assert own[0].text == {1: "", 2: "One Two"}.get(kind, "One. Two!") and own[0].role == ("user" if kind == 4 else "assistant")
