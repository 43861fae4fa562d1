import random

import numpy as np
from textkin.llm import decontaminate, tables
from textkin.llm.decontaminate import contained_items, needed, picked, slots

from tests.llm.test_near_dedup import shingles


def brute(docs, items):
    out = {}
    for d, t in docs:
        for i, u in items:
            a, b = shingles(t), shingles(u)
            short = (u or "").lower().split()
            if 0 < len(short) < 5:
                w = (t or "").lower().split()
                a, b = {" ".join(w[j:j + len(short)]) for j in range(len(w) - len(short) + 1)}, {" ".join(short)}
            if d is not None and i is not None and b and 100 * len(a & b) >= 75 * len(b):
                out[(d, i)] = max(out.get((d, i), (0, 0, 0)), (len(a & b) / len(b), len(a & b), len(b)))
    return sorted((d, i, x[1], x[2]) for (d, i), x in out.items())


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in contained_items(d, b).collect())


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([5, 6, 12, 40, 150, 400])))) for i in range(30)]
    docs = []
    for i in range(80):
        w = words(rng.randrange(20, 600))
        if i % 2:
            part = items[rng.randrange(30)][1].upper().split()
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = part
        docs.append((i, " ".join(w)))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus(4)
    want = brute(docs, items)
    assert len(want) > 20 and run(spark, docs, items) == want


def test_signatures_are_shorter_than_items_and_miss_nothing(spark):
    assert [slots(n) for n in (1, 7, 8, 15, 16, 31, 32, 64, 128, 999)] == [1, 7, 6, 6, 12, 12, 24, 48, 64, 64]
    assert [needed(n) for n in (1, 7, 8, 11, 15, 31, 55, 127, 128)] == [1, 6, 4, 4, 3, 5, 11, 17, 32]
    rng = np.random.default_rng(1)
    for n in [*range(8, 128), 200, 400, 1000]:
        item = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        signature = picked(item)
        assert len(set(signature.tolist())) == slots(n) < n and 1 <= needed(n) <= slots(n)
        for _ in range(20):  # documents that hold exactly three quarters
            held = rng.choice(item, -(-75 * n // 100), replace=False)
            assert np.isin(signature, held).sum() >= needed(n)


def test_every_size_partition_finds_all(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(n + 4))) for i, n in enumerate([1, 3, 7, 8, 12, 15, 16, 24, 31, 33, 50, 63, 64, 100, 127, 130, 300] * 2)]
    docs = []
    for i, text in items:
        for k in range(6):
            words = text.split()
            for _ in range(k * len(words) // 60):
                words[rng.randrange(len(words))] = "changed"
            docs.append((len(docs), " ".join([f"x{rng.randrange(99)}" for _ in range(50)] + words + ["end"] * 9)))
    want = brute(docs, items)
    assert {i for _, i, *_ in want} == {i for i, _ in items} and run(spark, docs, items) == want


def test_lookups_of_many_bytes_are_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "x" * 1000, [1, 2]) for i in range(40)], "k int, text string, a array<int>")
    small = tables.join_lookup(rows.select("k"), rows, "k")
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 40_000)
    large = tables.join_lookup(rows.select("k"), rows, "k")
    assert small.count() == large.count() == 40
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (small, large)]
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]


def test_edges(spark):
    text = "one two three four five six seven eight"
    docs = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "Two words"), (5, "two words and more of them"), (6, (text + " ") * 50_000)]
    items = [(1, text), (2, "two words"), (3, None), (4, ""), (None, text), (1, text), (5, text + " nine")]
    want = brute(docs, items)
    assert {(d, i) for d, i, *_ in want} >= {(1, 1), (4, 2), (5, 2), (6, 1)} and run(spark, docs, items) == want
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_documents_with_items_go(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y z"), (None, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "A b c d e f")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(docs, bench).collect()) == ["2", "None"]
