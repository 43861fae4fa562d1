import random

import pytest

from textkin.llm import substring_dedup
from textkin.llm.substring_dedup import levels, remove_repeats


def brute(rows, length):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - length + 1):
                key = tuple(w[p:p + length])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for p in range(len(w) - length + 1):
                if first[tuple(w[p:p + length])] < i:
                    gone.update(range(p, p + length))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, kept int")
    got = remove_repeats(df, **kw).collect()
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str)


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(vocabulary)}" for _ in range(rng.choice([5, 12, 13, 14, 20, 60]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            w += [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(15))] + rng.choice(passages)
        rows.append((i, "  ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length", [13, 30, 4])
def test_equals_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2000)
    rows = corpus(length, 60, 40) + [(100, None), (101, ""), (102, "a b"), (None, "p1 " * 20), (None, None), (103, "é  ü x " * 9), (104, "x é ü x " * 9)]
    assert run(spark, rows, length=length) == brute(rows, length)


def test_repeats_within_a_document_and_repeated_rows_stay(spark):
    rows = [(3, "a b c " * 20), (3, "a b c " * 20), (4, "x " + "a b c " * 20)]
    assert run(spark, rows) == brute(rows, 13)
    assert [r[2] for r in run(spark, rows)] == [0, 0, 60]


def test_no_rows(spark):
    assert run(spark, []) == []


def test_levels_double():
    assert levels(13) == [7, 13] and levels(50) == [7, 13, 25, 50] and levels(7) == [7] and levels(1) == [1]
