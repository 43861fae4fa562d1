import random

from textkin.llm import near_dedup

SCHEMA = "doc_id long, text string, k1 int, rep string"


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Expected result of rows (id, text) with non-null ids."""
    ids = sorted({i for i, _ in rows})
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def result(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in near_dedup.near_duplicates(df, **kw).collect()), key=str)


def corpus(seed, groups, copies, length):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            own = [rng.choice(vocabulary) if rng.random() < 0.03 * rng.random() else w for w in base]
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus(1, 8, 6, 80) + [(1000, None), (1001, ""), (1002, "short text"), (1003, "Short  text"), (1004, "text short")]
    rows += [(1005, rows[0][1]), (1006, rows[0][1].upper())]
    assert result(spark, rows) == sorted(brute(rows), key=str)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SKETCH_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 8)
    rows = corpus(2, 1, 60, 70) + [(i + 100, t) for i, t in corpus(3, 20, 1, 40)]
    assert result(spark, rows) == sorted(brute(rows), key=str)


def test_nulls_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (3, text + " eight"), (None, text), (None, None), (9, "other words"), (9, "one two three four five six seven eight")]
    got = result(spark, rows)
    assert [r for r in got if r[0] is None] == [(None, 0, None, True), (None, 3, None, True)]
    assert {(r[0], r[2], r[3]) for r in got if r[0] is not None} == {(5, 3, False), (3, 3, True), (9, 3, False)}
    assert len(got) == len(rows)


def test_no_rows(spark):
    assert result(spark, []) == []
    empty = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert near_dedup.drop_near_duplicates(empty).columns == empty.columns


def test_one_document_of_a_group_stays(spark):
    rows = [(7, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (4, "quite different words are in this one"), (None, "a b c d e f g h i j")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_duplicates(df).collect()) == ["2", "4", "None"]
