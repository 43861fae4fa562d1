from textkin.llm.line_dedup import drop_boilerplate

SCHEMA = "doc_id long, source string, text string, n_lines string, line_keys int"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    out = drop_boilerplate(df, **kw)
    assert out.columns == ["doc_id", "source", "text", "n_lines", "line_keys", "n_lines_", "n_dropped"]
    return {r[0]: (r["text"], r["n_lines_"], r["n_dropped"]) for r in out.collect()}


def test_lines_of_too_many_pages_of_a_host_go(spark):
    rows = [(i, "a", f"menu\npage {i}\n  menu \n\nfoot{i // 6}") for i in range(10)] + [(20 + i, "b", f"menu\nown {i}") for i in range(3)]
    got = run(spark, rows, ratio=0.5, min_pages=5)
    assert got[0] == ("page 0\n", 5, 3) and got[9] == ("page 9\n\nfoot1", 5, 2)
    assert got[20] == ("menu\nown 0", 2, 0)  # three pages are too few


def test_the_ratio_must_be_exceeded(spark):
    rows = [(i, "a", "half\nx" if i < 5 else f"y{i}") for i in range(10)]
    assert run(spark, rows, ratio=0.5, min_pages=1)[0] == ("half\nx", 2, 0)
    assert run(spark, rows, ratio=0.49, min_pages=1)[0] == ("", 2, 2)


def test_nulls_and_empty_texts(spark):
    rows = [(1, None, "same\nsame"), (2, None, "same"), (3, "a", None), (4, "a", ""), (5, "a", "same"), (6, "a", "same"), (None, "a", "same")]
    got = run(spark, rows, ratio=0.1, min_pages=2)
    assert got == {1: ("same\nsame", 2, 0), 2: ("same", 1, 0), 3: (None, 0, 0), 4: ("", 1, 0), 5: ("", 1, 1), 6: ("", 1, 1), None: ("", 1, 1)}
    assert run(spark, []) == {}


def test_long_pages_and_the_join_without_broadcast(spark, monkeypatch):
    from textkin.llm import tables

    monkeypatch.setattr(tables.join_lookup, "__defaults__", ("left", "lookup", 0))
    long = "\n".join(f"l{i}" for i in range(50_000))
    got = run(spark, [(i, "a", "menu\n" + long + str(i)) for i in range(3)] + [(9, "a", "menu")], ratio=0.9, min_pages=2)
    assert got[9] == ("", 1, 1) and got[0] == (long + "0", 50_001, 1)


def test_copies_count_once_and_pages_of_boilerplate_are_spared(spark):
    copy = "long text\n\nof a copy"
    rows = [(i, "a", copy) for i in range(6)] + [(10 + i, "a", f"menu\npage {i}") for i in range(6)] + [(20, "a", " menu\n")]
    got = run(spark, rows, distinct=True, spare=True)
    assert {got[i] for i in range(6)} == {(copy, 3, 0)} and got[10] == ("page 0", 2, 1) and got[20] == (" menu\n", 2, 0)
    assert run(spark, rows, distinct=True)[20] == ("", 2, 1) and run(spark, rows, spare=True)[0] == (copy, 3, 0)
    assert run(spark, rows)[0] == ("", 3, 2)
    # Five rows, but four texts.
    assert run(spark, [(i, "a", f"same\n{min(i, 3)}") for i in range(5)], distinct=True)[0] == ("same\n0", 2, 0)


def test_rows_of_one_page_count_once(spark):
    from textkin.llm.line_dedup import boilerplate

    rows = [("a", f"menu\nshared\nown {i}", 1 if i < 6 else None) for i in range(6)] + [("a", f"menu\npage {i}", None) for i in range(6)]
    df = spark.createDataFrame(rows, "host string, text string, g long")
    found = {r.host: len(r.line_keys) for r in boilerplate(df, host="host", page="g").collect()}
    assert found == {"a": 1}  # seven pages hold the menu, one the shared line
    assert {r.host: len(r.line_keys) for r in boilerplate(df, host="host", distinct=True).collect()} == {"a": 2}
    assert boilerplate(df.where("g = 1"), host="host", page="g").collect() == []
