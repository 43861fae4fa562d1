import math
import random

import pytest

from textkin.llm import topk


def brute(rows, ids, k):
    usable = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ids:
        best = {}
        for i, v in usable:
            for j, u in usable:
                if i == q and j != q and len(u) == len(v):
                    best[j] = max(best.get(j, -math.inf), sum(a * b for a, b in zip(u, v)))
        for r, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, r, j, s))
    return sorted(out)


def run(spark, rows, ids, k=5):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    return sorted(tuple(r) for r in topk.top_k(df, df.where(df.vec_id.isin(*ids)) if ids else df.limit(0), k=k).collect())


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "STEP", 4)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 4, 1) * spread for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, []), (302, [1.0, None]), (303, [math.nan] * 6), (304, [math.inf] * 6), (None, rows[0][1])]
    rows += [(310, [1.0, 2.0]), (311, [3.0, -1.0]), (312, [0.5]), (7, rows[9][1]), rows[11], rows[11]]
    ids = [0, 7, 11, 50, 200, 300, 302, 310, 312, 999]
    assert run(spark, rows, ids) == brute(rows, ids, 5)


def test_fewer_candidates_than_k_and_no_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])]
    assert run(spark, rows, [1]) == brute(rows, [1], 5) and len(run(spark, rows, [1])) == 2
    assert run(spark, [], []) == [] and run(spark, rows, []) == []


def test_scores_beyond_a_long_stay_at_its_ends(spark):
    got = run(spark, [(1, [1e18]), (2, [1e18]), (3, [-1e18])], [1])
    assert got == [(1, 1, 2, (1 << 63) - 1), (1, 2, 3, -(1 << 63))]


def test_floors_are_rounded_down(spark):
    assert run(spark, [(1, [-0.001]), (2, [1.0]), (3, [0.999])], [1]) == [(1, 1, 3, -255), (1, 2, 2, -256)]
