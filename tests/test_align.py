"""Alignment against a dense restatement."""

import numpy as np
import pytest

from textkin.operators import align


def dense_runs(sim, t, min_length, min_strength):
    nl, nr = sim.shape
    sw = np.zeros((nl, nr))
    for i in range(nl):
        for j in range(nr):
            if sim[i, j] > t:
                up = sw[i - 1, j] if i else 0
                left = sw[i, j - 1] if j else 0
                diag = sw[i - 1, j - 1] if i and j else 0
                sw[i, j] = sim[i, j] - t + max(up, left, diag, 0)
    left_sim, out, num = sim.copy(), {}, 0
    while sw.max() > 0:
        i, j = np.unravel_index(sw.argmax(), sw.shape)
        run = [(i, j)]
        while True:
            steps = [(a, b) for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0 and left_sim[a, b] > t]
            if not steps:
                break
            i, j = max(steps, key=lambda c: left_sim[c])
            run.append((i, j))
        for a, b in run:
            sw[a, :] = sw[:, b] = 0
            left_sim[a, :] = left_sim[:, b] = 0
        if len(run) > min_length and sum(sim[c] for c in run) > min_strength:
            out[num] = {(int(a), int(b)) for a, b in run}
        num += 1
    return out


def matrices():
    rng = np.random.default_rng(11)
    for k, (nl, nr) in enumerate([(12, 12), (20, 9), (7, 25), (30, 30)]):
        m = rng.random((nl, nr)) * 0.4
        for i in range(min(nl, nr)):
            m[i, i] = 0.6 + rng.random() * 0.4
        yield f"p{k}", m.round(6)


@pytest.mark.parametrize("threshold", [0.2, 0.35])
def test_runs_equal_the_dense_algorithm(spark, threshold):
    cells, want = [], {}
    for name, m in matrices():
        cells += [(name, "r", i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
        want[name] = dense_runs(m, threshold, 3, 0.0)
    df = spark.createDataFrame(cells, "left string, right string, left_seq int, right_seq int, sim double")
    got = {}
    for r in align.alignment_runs(df, threshold, 3).collect():
        got.setdefault(r["left"], {}).setdefault(r["run_num"], set()).add((r["left_seq"], r["right_seq"]))
    for name, runs in want.items():
        assert got.get(name, {}) == runs


def dense_scores(sim, t):
    sw = np.zeros((sim.shape[0] + 1, sim.shape[1] + 1))
    for i in range(sim.shape[0]):
        for j in range(sim.shape[1]):
            if sim[i, j] > t:
                sw[i + 1, j + 1] = sim[i, j] - t + max(sw[i, j + 1], sw[i + 1, j], sw[i, j])
    return sw[1:, 1:]


@pytest.mark.parametrize("tile", [5, 256])
def test_scores_in_tiles_equal_the_dense_matrix(spark, tile):
    cells = [(name, "r", i, j, float(m[i, j])) for name, m in matrices() for i in range(m.shape[0]) for j in range(m.shape[1])]
    df = spark.createDataFrame(cells + [("p0", "r", 90, 90, float("nan")), ("p0", "r", 91, 91, None), ("far", "r", 700, 3, 0.9)],
                               "left string, right string, left_seq int, right_seq int, sim double")
    got = {(r.left, r.left_seq, r.right_seq): r.score for r in align.score_cells(df, 0.2, tile).collect()}
    want = {(name, i, j): x for name, m in matrices() for (i, j), x in np.ndenumerate(dense_scores(m, 0.2)) if x > 0}
    want["far", 700, 3] = 0.7
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert align.score_cells(df.where("sim < 0"), 0.2).collect() == []


def test_slopes_and_statistics(spark):
    cells = [("a", "b", i, i + 2, 0.9) for i in range(10)]
    df = spark.createDataFrame(cells, "left string, right string, left_seq int, right_seq int, sim double")
    runs = align.alignment_runs(df, 0.2)
    sizes = spark.createDataFrame([("a", 10), ("b", 20)], "htid string, n long")
    s = align.run_statistics(runs, df, sizes).first()
    assert (s["mean_page_diff"], s["sd_page_diff"], s["share_l_in_r"], s["share_r_in_l"]) == (2.0, 0.0, 0.5, 1.0)
    assert s["sim_beside_runs"] == 0.0
    pages = spark.createDataFrame([("a", i, 10) for i in range(10)] + [("b", i, 20) for i in range(20)], "htid string, idx int, n_tokens long")
    r = align.run_slopes(runs, pages).first()
    assert r["overall_slope"] == pytest.approx(1.0) and r["strength_of_overall_fit"] == pytest.approx(1.0)
    assert r["in_run_page_slope"] == pytest.approx(1.0) and r["in_run_word_slope"] == pytest.approx(0.5)


def test_higher_threshold_never_aligns_more_strength(spark):
    name, m = next(iter(matrices()))
    cells = [(name, "r", i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    df = spark.createDataFrame(cells, "left string, right string, left_seq int, right_seq int, sim double")
    p = df.select("left", "right").distinct()
    r = align.run_lengths(p, df, [0.3, 0.99]).first()
    assert r["sw_0700_len"] >= r["sw_0010_len"] == 0
