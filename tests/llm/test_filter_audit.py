import re
from collections import Counter
from itertools import permutations

import numpy as np
from textkin.llm.filter_audit import audit, contract, flag_documents, steps

SCHEMA = "doc_id long, text string, source string, w string, cells int, part string"


def fails(docs, labels):
    """Failed filters and labels of each document, one by one."""
    out = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = ""
        bad += "A" if len(words) < 200 else ""
        bad += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        bad += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
        bad += "D" if re.search("[#$%&*|]", text) else ""
        bad += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else ""
        own = [r for r in labels if i is not None and r[0] == i]
        out.append((source or "", bad, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    return out


def brute(docs, labels):
    rows, out = fails(docs, labels), {}
    for part in {r[0] for r in rows}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(now)
                out[part, order, step] = [len(left), len(now), sum(f in r[1] for r in gone), sum(r[1] == f for r in rows if r[0] == part),
                                          sum(r[2] for r in now), sum(r[3] for r in now)]
                gone += now
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(total[f])
    return out


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 0, "y") for r in docs], SCHEMA)
    rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, id string, good int")
    got = audit(flag_documents(d, rows))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len({r[:3] for r in got})
    return {r[:3]: list(r[3:]) for r in got}


def test_against_counting_document_by_document(spark):
    rng = np.random.default_rng(5)
    texts = ["", None, "a", "A b", "a # b", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i % 90}" for i in range(250)),
             "X" * 9 + " " + " ".join(f"ü{i}" for i in range(220)), "a b\x0bc", "w " * 20_000, " | ".join(f"z{i}" for i in range(300))]
    docs = [(int(i) if i else None, texts[rng.integers(len(texts))], [None, "", "p", "q"][rng.integers(4)]) for i in rng.integers(0, 60, 90)]
    labels = [(int(i) if i else None, [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)], "x", 7) for i in rng.integers(0, 60, 50)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables_and_no_labels(spark):
    assert run(spark, [], []) == {}
    docs = [(3, "same", "p"), (1, "same", "q"), (2, None, "p"), (4, "", "p")]
    got = run(spark, docs, [])
    assert got == brute(docs, []) and got["p", "EABCD", 1][:2] == [1, 2] and got["q", "EABCD", 1][:2] == [1, 0]


def test_a_group_of_copies_and_many_parts(spark):
    docs = [(i, "one text", f"p{i % 150}") for i in range(600)]
    got = run(spark, docs, [(0, 1, 1, "x", 7)])
    assert len(got) == 150 * 600 and got["p0", "EABCD", 1][:2] == [1, 3] and got["p7", "EABCD", 1][:2] == [0, 4]
    assert got["p0", "ABCDE", 1] == [0, 4, 0, 1, 1, 1, sum(r[1] for k, r in got.items() if k[0] == "p0" and k[1][k[2] - 1] == "A")]


def test_contraction_selects_pass_fail_and_all():
    x = np.arange(2 * 8 * 3).reshape(2, 2, 2, 2, 3)
    y = contract(x, 3)
    assert y.shape == (2, 3, 3, 3, 3) and (y[:, 2, 2, 2] == x.sum(axis=(1, 2, 3))).all() and (y[:, 0, 1, 2] == x[:, 0, 1].sum(axis=1)).all()
    assert len(steps("ABC")) == 18
