"""Components, communities, PageRank and folding."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textkin.operators import centrality, graph, local_graph, representative
from textkin.plans import works
from textkin.schemas import LABELS
from textkin.session import bucketed, drop_bucketed, shuffle_parts


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_with_a_hub_and_a_chain(spark, monkeypatch):
    random.seed(5)
    edges = [("n000", f"n{i:03d}") for i in range(1, 60)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    edges += [(f"r{random.randrange(80)}", f"r{random.randrange(80)}") for _ in range(60)]
    df = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    got = {r["id"]: r["label"] for r in graph.connected_components(df).collect()}
    assert got == union_find([(a, b) for a, b in edges if a != b])
    for size in (7, 200_000):
        monkeypatch.setattr(local_graph, "FOREST_EDGES", size)
        assert {r["id"]: r["label"] for r in graph.connected_components(df, forests=True).collect()} == got
    assert graph.connected_components(df.where("src = 'none'"), forests=True).collect() == []


def test_louvain_finds_planted_groups(spark):
    random.seed(2)
    rows = [(f"n{b}_{i:02d}", f"n{b}_{j:02d}") for b in range(4) for i in range(10) for j in range(i) if random.random() < 0.7]
    rows += [(f"n{b}_00", f"n{b + 1}_05") for b in range(3)]
    df = spark.createDataFrame(rows, "target string, candidate string")
    got = {r["id"]: r["label"] for r in graph.louvain(df, "target", "candidate").collect()}
    assert len(got) == 40
    assert {i: l for i, l in got.items()} == {i: i.split("_")[0] + "_00" for i in got}


def modularity(edges, label):
    m, total, inner = sum(w for _, _, w in edges), {}, 0.0
    for a, b, w in edges:
        inner += w * (label[a] == label[b])
        for x in (a, b):
            total[label[x]] = total.get(label[x], 0.0) + w
    return inner / m - sum((t / (2 * m)) ** 2 for t in total.values())


def test_components_are_worked_on_apart_and_large_ones_in_rounds(spark, monkeypatch):
    random.seed(4)
    edges = []
    for g in range(12):  # components of several communities
        for b in range(3):
            edges += [(f"g{g:02d}b{b}n{i}", f"g{g:02d}b{b}n{j}", 1.0 + (i + j) % 3) for i in range(6) for j in range(i) if random.random() < 0.8]
        edges += [(f"g{g:02d}b{b}n1", f"g{g:02d}b{(b + 1) % 3}n2", 0.5) for b in range(3)]
    edges += [(f"big{i:02d}", f"big{j:02d}", 1.0) for i in range(40) for j in range(i) if i // 10 == j // 10 or (i + j) % 37 == 0]
    df = spark.createDataFrame(edges, "src string, dst string, w double")
    found, q = {}, {}
    for limit in (100_000, 100):
        monkeypatch.setattr(graph, "LOCAL_EDGES", limit)
        found[limit] = {r["id"]: r["label"] for r in graph.louvain(df, weight="w").collect()}
        q[limit] = modularity(edges, found[limit])
        assert all(min(x for x in found[limit] if found[limit][x] == c) == c for c in found[limit].values())
    assert {x: c for x, c in found[100].items() if x[0] == "g"} == {x: c for x, c in found[100_000].items() if x[0] == "g"}
    planted = {x: x[:5] if x[0] == "g" else x[:4] for x in found[100]}
    assert min(q.values()) >= modularity(edges, planted) - 0.02


def test_communities_are_connected():
    random.seed(9)
    edges = [(a, b, 1.0) for a in range(60) for b in range(a) if random.random() < 0.07]
    label = local_graph.communities(*zip(*edges), 2.0 * len(edges))
    for c in set(label.values()):
        inside = [(a, b) for a, b, _ in edges if label[a] == label[b] == c]
        assert sum(x == c for x in label.values()) == 1 or len(set(union_find(inside).values())) == 1 and len(union_find(inside)) == sum(x == c for x in label.values())
    assert modularity(edges, label) > 0.25
    assert local_graph.communities([], [], [], 1.0) == {}


def test_every_volume_gets_one_label(spark):
    preds = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f")], "target string, candidate string")
    strong = preds.where("target = 'a'")
    out = graph.cluster_all(preds, strong, "man_id", "components").collect()
    by = {r["htid"]: r["man_id"] for r in out}
    assert len(out) == len(by) == 6
    assert by["a"] == by["b"] and len(set(by.values())) == 5


def test_pagerank_sums_to_one_and_prefers_the_centre(spark):
    members = spark.createDataFrame([(1, x) for x in "abcd"] + [(2, x) for x in "xyz"], "cluster int, htid string")
    edges = spark.createDataFrame([(1, "a", "b", 1.0), (1, "a", "c", 1.0), (1, "a", "d", 1.0), (2, "x", "y", 0.5)],
                                  "cluster int, target string, candidate string, w double")
    r = {(x["cluster"], x["htid"]): x["rank"] for x in centrality.pagerank(members, edges, rounds=30).collect()}
    assert sum(v for (c, _), v in r.items() if c == 1) == pytest.approx(1.0)
    assert sum(v for (c, _), v in r.items() if c == 2) == pytest.approx(1.0)
    assert max((v, k) for k, v in r.items() if k[0] == 1)[1] == (1, "a")
    assert r[2, "z"] < r[2, "x"] == pytest.approx(r[2, "y"])
    settled = {(x["cluster"], x["htid"]): x["rank"] for x in centrality.pagerank(members, edges, tolerance=1e-9).collect()}
    assert settled.keys() == r.keys() and all(abs(settled[k] - r[k]) < 1e-2 for k in r)


def ranks_by_hand(members, edges, rounds, damping=0.85):
    """Rounds of one cluster after the other, as a dense matrix."""
    out = {}
    for c in {c for c, _ in members}:
        ids = sorted({x for k, x in members if k == c})
        at = {x: i for i, x in enumerate(ids)}
        flow, n = np.zeros((len(ids), len(ids))), len(ids)
        total = np.zeros(n)
        for k, a, b, w in edges:
            for s, d in ((a, b), (b, a)):
                if k == c and a != b and w > 0 and s in at:
                    total[at[s]] += w
                    if d in at:
                        flow[at[d], at[s]] += w
        flow = flow / np.where(total > 0, total, 1)
        x = np.full(n, 1 / n)
        for _ in range(rounds):
            got = flow @ x
            x = (1 - damping) / n + damping * (got + (x.sum() - got.sum()) / n)
        out |= {(c, i): r for i, r in zip(ids, x)}
    return out


def test_pagerank_whole_and_in_rounds_are_the_same(spark):
    rng = np.random.default_rng(4)
    members = [(c, f"v{i:03d}") for c in range(4) for i in range((5, 40, 90, 1)[c])] + [(1, "v000")]
    edges = [(c, f"v{a:03d}", f"v{b:03d}", float(w)) for c, n, k in ((0, 3, 4), (1, 36, 80), (2, 91, 200)) for a, b, w in
             zip(rng.integers(0, n, k), rng.integers(0, n, k), rng.random(k))]
    edges += [(2, "v000", f"v{i:03d}", 0.5) for i in range(1, 80)]  # a hub
    edges += [(2, "v001", "v002", 0.0), (2, "v001", "v002", None), (9, "x", "y", 1.0)]
    m = spark.createDataFrame([*members, (None, "v001"), (1, None)], "cluster int, htid string")
    e = spark.createDataFrame(edges, "cluster int, target string, candidate string, w double")
    tables = len(spark.catalog.listTables())
    want = ranks_by_hand(members, [x for x in edges if x[3] is not None], 4)
    for options in ({}, {"local_rows": 60}, {"local_rows": 0, "hub_edges": 30}):
        rows = centrality.pagerank(m, e, rounds=4, **options).collect()
        got = {(r["cluster"], r["htid"]): r["rank"] for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    settled = [centrality.pagerank(m, e, tolerance=1e-2, step=3, local_rows=n).collect() for n in (0, 1000)]
    a, b = ({(r["cluster"], r["htid"]): r["rank"] for r in rows} for rows in settled)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-2 for k in a)
    assert centrality.pagerank(m.limit(0), e).collect() == [] and centrality.pagerank(m, e.limit(0), rounds=2).count() == len(want)
    assert len(spark.catalog.listTables()) == tables


def test_a_round_of_pagerank_shuffles_once(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = shuffle_parts(spark)
        flows = bucketed(spark.range(500).selectExpr("id % 3 AS cluster", "id % 50 AS src", "id % 49 AS dst", "0.1D AS share"), "flows", ["cluster", "src"], parts)
        state = bucketed(spark.range(150).selectExpr("id % 3 AS cluster", "id % 50 AS htid", "0.02D AS v", "array(0.02D) AS vectors"), "ranks", ["cluster", "htid"], parts)
        plan = centrality._next(state, flows, 0.85)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange ") == 1
    finally:
        drop_bucketed(flows)
        drop_bucketed(state)
        for k, v in keep.items():
            spark.conf.set(k, v)


def fold_reference(pairs, thresholds):
    """Base pairs re-aggregated from scratch in every pass, for both levels."""
    ids = sorted(set(pairs["target"]) | set(pairs["candidate"]))
    cur = {i: i for i in ids}

    def level():
        t = pairs.assign(t=pairs["target"].map(cur), c=pairs["candidate"].map(cur))
        swap = t["t"] > t["c"]
        po, co = t["p_partof"].copy(), t["p_contains"].copy()
        t.loc[swap, ["t", "c"]] = t.loc[swap, ["c", "t"]].values
        t["p_partof"], t["p_contains"] = po.where(~swap, co), co.where(~swap, po)
        w = t[LABELS].mul(t["count"], axis=0).assign(t=t["t"], c=t["c"], count=t["count"])
        g = w.groupby(["t", "c"]).sum()
        g[LABELS] = g[LABELS].div(g["count"], axis=0)
        return g.reset_index()

    result = {}
    for name, cols in (("man_id", ["p_swsm"]), ("work_id", ["p_swsm", "p_swde"])):
        for p in thresholds:
            g = level()
            e = g[(g[cols].sum(axis=1) > p) & (g["t"] < g["c"])]
            if e.empty:
                continue
            label = union_find(list(e[["t", "c"]].itertuples(index=False, name=None)))
            cur = {i: label.get(x, x) for i, x in cur.items()}
        result[name] = dict(cur)
    return result


def test_folding_matches_re_aggregation_from_the_base(spark):
    rng = np.random.default_rng(8)
    rows = set()
    while len(rows) < 150:
        a, b = sorted(rng.integers(0, 60, 2))
        if a != b:
            rows.add((f"v{a:02d}", f"v{b:02d}"))
    probs = rng.dirichlet(np.full(10, 0.15), len(rows))
    pdf = pd.DataFrame(sorted(rows), columns=["target", "candidate"])
    pdf[LABELS] = probs
    pdf["count"] = rng.integers(2, 5, len(rows))
    thresholds = [0.99, 0.95, 0.9, 0.8]
    want = fold_reference(pdf, thresholds)
    ref, man, work = works.volumes_to_works(spark.createDataFrame(pdf), thresholds, "components")
    rows = ref.collect()
    assert {r["htid"]: r["man_id"] for r in rows} == want["man_id"]
    assert {r["htid"]: r["work_id"] for r in rows} == want["work_id"]
    assert work.where("target > candidate").isEmpty()
    assert work.groupBy("target", "candidate").count().where("count > 1").isEmpty()


def test_best_copy_is_nearest_and_null_without_open_copies(spark):
    d = spark.createDataFrame([(1, "b", 0.2, "deny"), (1, "a", 0.2, "deny"), (1, "c", 0.5, "allow"), (2, "x", 0.1, "deny")],
                              "cluster int, htid string, dist double, access string")
    r = {x["cluster"]: x for x in representative.best_copies(d, {"best": ("dist", "min")}).collect()}
    assert (r[1]["best"], r[1]["best_pd"]) == ("a", "c")
    assert (r[2]["best"], r[2]["best_pd"]) == ("x", None)


def test_registered_folding_takes_all_thresholds_and_communities(spark, monkeypatch):
    from catalog import graphs

    p = {("a", "b"): 0.975, ("b", "c"): 0.94, ("a", "c"): 0.0}  # c joins only where 0.97 is skipped
    groups = [[f"{g}{i}" for i in range(6)] for g in "xy"]
    p |= {(g[j], g[i]): 0.995 for g in groups for i in range(6) for j in range(i)}
    p |= {(x, y): 0.995 if (x, y) == ("x0", "y0") else 0.1 for x in groups[0] for y in groups[1]}
    pdf = pd.DataFrame([(*k, x) for k, x in p.items()], columns=["target", "candidate", "p_swsm"])
    pdf[[c for c in LABELS if c != "p_swsm"]] = 0.0
    pdf["count"] = 2
    df = spark.createDataFrame(pdf[["target", "candidate", *LABELS, "count"]])
    monkeypatch.setattr(graphs, "clean", lambda spark, sf: df)

    def folded(query):
        rows = query(spark, None).collect()
        assert sorted(r.htid for r in rows) == sorted({x for k in p for x in k})
        assert len({(r.man_id, r.work_id) for r in rows}) == len({r.man_id for r in rows})
        return {r.htid: r.work_id for r in rows}

    def modularity(label):
        strong = [k for k, x in p.items() if x > 0.99]
        ends = [label[x] for k in strong for x in k]
        return sum(label[a] == label[b] for a, b in strong) / len(strong) - sum((ends.count(c) / len(ends)) ** 2 for c in set(ends))

    chains, groups = folded(graphs.g4_fold_by_components), folded(graphs.g4_fold_to_works)
    assert chains["a"] == chains["b"] != chains["c"] and groups["a"] == groups["b"] != groups["c"]
    assert chains["x0"] == chains["y0"] and {groups[f"x{i}"] for i in range(6)} == {"x0"} and {groups[f"y{i}"] for i in range(6)} == {"y0"}
    assert modularity(groups) > 0.4 > modularity(chains)
