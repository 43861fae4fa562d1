import corpus_pipeline
from textkin.llm import queries
from textkin.llm.tables import table

from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as components


def test_stages_take_effect_one_after_the_other(spark, sf):
    docs = table(spark, sf, "documents").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, docs, sf)
    rejected = {r.doc_id for r in queries.op6_toxicity(spark, sf).where("predicted = 1").collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(ids) == sorted({r.doc_id for r in docs.collect()} - rejected)

    lines = stages["line dedup"](spark, kept, sf)
    assert lines.columns == docs.columns and lines.count() == len(ids)

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    one = stages["near dedup"](spark, docs, sf)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, _, _, first in components(rows) if first)

    clean = stages["decontamination"](spark, docs, sf)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, *_ in leaks(rows, items)}


def test_the_whole_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 20 < len(ids) < 200


def test_one_document_of_a_copy_group_survives_with_its_text(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    copy = "a text that was copied many times\nwith a second line of its own words"
    rows = [(i, copy, "h") for i in range(10)] + [(10 + i, copy + f" {i}", "k") for i in range(6)]
    rows += [(100 + i, "menu\n" + " ".join(f"w{i}x{j}" for j in range(12)), h) for i in range(40) for h in ("hk"[i % 2],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in stages["near dedup"](spark, stages["line dedup"](spark, docs, sf), sf).collect()}
    assert out[0] == copy and not set(out) & set(range(1, 10))
    assert all(out[100 + i] == rows[16 + i][1].split("\n")[1] for i in range(40))


def test_the_draw_has_effect_beside_a_column_named_sampled(spark, sf):
    mix = dict(corpus_pipeline.STAGES)["mixing"]
    docs = table(spark, sf, "documents")
    want = sorted(r.doc_id for r in mix(spark, docs, sf).collect())
    assert 0 < len(want) < docs.count()
    for own in (True, "x"):
        got = mix(spark, docs.selectExpr("*", f"{own!r} AS Sampled"), sf)
        assert "Sampled" in got.columns and "sampled_" not in got.columns
        assert sorted(r.doc_id for r in got.collect()) == want and {r.Sampled for r in got.collect()} == {own}


def test_near_copies_keep_the_lines_they_share(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    shared = [" ".join(f"s{j}x{k}" for k in range(9)) for j in range(14)]
    rows = [(i, "\n".join([*shared, f"own line {i} of this copy"]), "h") for i in range(20)]
    rows += [(100 + i, "\n".join(["menu of the site", *[" ".join(f"w{i}x{j}x{k}" for k in range(9)) for j in range(6)]]), "h") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in stages["near dedup"](spark, stages["line dedup"](spark, docs, sf), sf).collect()}
    assert out[0] == rows[0][1] and not set(out) & set(range(1, 20))
    assert all(out[100 + i] == rows[20 + i][1].split("\n", 1)[1] for i in range(100))


def test_odd_rows_pass_every_stage(spark, sf):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, None, None, None), (None, text, "en", "h"), (1, "", "en", "h"), (1, "", "en", "h"), (2, None, None, "h"), (3, text, "de", None),
            (3, text, "de", None), (4, " \n ", "en", "h"), (5, "long " * 60_000, "en", "h"), (6, text + " more", None, "h")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = plain.selectExpr("*", *[f"'x' AS {c}" for c in ("predicted", "score", "near_copies", "line_keys", "component_id", "kept", "tokens", "topic", "n_lines")])
    for name, stage in corpus_pipeline.STAGES:
        got, other = stage(spark, plain, sf).collect(), stage(spark, odd, sf).collect()
        ids = sorted(str(r.doc_id) for r in got)
        assert ids == sorted(str(r.doc_id) for r in other)
        assert stage(spark, plain.where("false"), sf).collect() == []
        if name in ("toxicity", "line dedup", "decontamination"):
            assert len(got) == len(rows)
        if name == "near dedup":
            assert ids.count("None") == 2 and ids.count("1") == 2 and ids.count("3") == 2 and ids.count("6") == 0
