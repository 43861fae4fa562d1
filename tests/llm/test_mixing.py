from pyspark.sql import functions as F

from textkin.llm.mixing import calibrate, cells_of, draw, gap, mix_to_targets, rake, token_count

SCHEMA = "doc_id long, text string, lang string, source string, p string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def corpus(n=400):
    return [(i, "w " * (1 + i % 7), ["en", "de", None][i % 3], "big" if i % 4 else "small") for i in range(n)]


def test_raked_sums_follow_the_targets(spark):
    df = docs(spark, corpus())
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    cells = cells_of(df, dims, token_count(F.col("text")))
    targets = {"source": spark.createDataFrame([("big", 0.4), ("small", 0.6)], "value string, share double"),
               "lang": spark.createDataFrame([("en", 0.5), ("de", 0.2), ("(none)", 0.3)], "value string, share double")}
    raked = rake(cells, targets, rounds=12).cache()
    assert gap(raked, targets) < 1e-9
    assert abs(raked.agg(F.sum("w")).first()[0] - 1) < 1e-9


def test_expected_tokens_and_weights(spark):
    df = docs(spark, corpus())
    out = mix_to_targets(df, keep=0.5).cache()
    assert out.columns == ["doc_id", "text", "lang", "source", "p", "tokens", "topic", "p_", "weight", "sampled"]
    r = out.agg(F.sum(F.col("tokens") * F.col("p_")), F.sum("tokens"), F.max("p_"), F.min("weight")).first()
    assert abs(r[0] - 0.5 * r[1]) < 1e-6 and r[2] <= 1 and r[3] == 1
    shares = {x["source"]: x["s"] for x in out.groupBy("source").agg((F.sum(F.col("tokens") * F.col("p_") * F.col("weight"))).alias("s")).collect()}
    own = {x["source"]: x["s"] for x in out.groupBy("source").agg(F.sum("tokens").alias("s")).collect()}
    flat = {k: v ** 0.5 for k, v in own.items()}
    assert abs(shares["big"] / sum(shares.values()) - flat["big"] / sum(flat.values())) < 1e-3
    assert out.where(F.col("sampled") != (draw(F.col("doc_id")) < F.col("p_"))).count() == 0


def test_filled_cells_are_set_aside(spark):
    factors = spark.createDataFrame([(10.0, 9.0), (90.0, 1.0), (100.0, 0.5)], "n double, factor double")
    c = calibrate(factors, 0.5)
    assert abs(sum(n * min(1, c * f) for n, f in [(10, 9), (90, 1), (100, 0.5)]) - 100) < 1e-9 and c * 9 >= 1


def test_nulls_empty_texts_and_no_rows(spark):
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, None, "en", "a"), (3, "x y", "en", "a"), (3, "x y", "en", "a"), (4, "z " * 300_000, "en", "b")]
    out = mix_to_targets(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.tokens) for r in out) == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("4", 300_000), ("None", 0)]
    assert len({r.sampled for r in out if r.doc_id == 3}) == 1 and all(0 < r.p_ <= 1 for r in out)
    assert mix_to_targets(docs(spark, [])).collect() == []
