import numpy as np

from pyspark.sql import functions as F

from textkin.llm import language_id, queries
from textkin.llm.language_id import fit, predict


def test_counts_follow_the_naive_bayes_rule(spark):
    rows = [("abab", "x"), ("abc", "x"), ("bcbc", "y"), (None, "y"), ("zz", None)]
    model = fit(spark.createDataFrame(rows, "text string, lang string"))
    grams = lambda t: [t[i:i + n] for n in (2, 3) for i in range(len(t) - n + 1)]
    counts = {k: [g for t, x in rows if x == k and t for g in grams(t)] for k in "xy"}
    score = []
    for k, n in (("x", 2), ("y", 1)):
        s = np.log(n / 3)
        for g in grams("abcb"):
            s += np.log(counts[k].count(g) + language_id.SMOOTHING) - np.log(len(counts[k]) + language_id.SMOOTHING * language_id.BUCKETS)
        score.append(s)
    expected = np.exp(score - np.logaddexp(*score))
    assert model.langs == ["x", "y"] and np.allclose(model.posteriors(["q", "abcb", ""])[1], expected, atol=1e-5)


def test_edges(spark):
    model = fit(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string"))
    rows = [(1, "the dog", "a", 0.5), (1, "the dog", "a", 0.5), (None, "die katze", None, None), (3, None, "b", 1.0), (4, "", "b", 1.0),
            (5, "123 ²³ -- !", "b", 1.0), (6, "THE CAT " * 200_000, "b", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    out = predict(docs, model, keep=("doc_id", "lang_pred", "score"))
    assert out.columns == ["doc_id", "lang_pred", "score", "lang_pred_", "score_"]
    got = sorted(((r.doc_id, r.lang_pred_, r.score_ > 0.5) for r in out.collect()), key=str)
    assert got == [(1, "en", True), (1, "en", True), (3, "und", False), (4, "und", False), (5, "und", False), (6, "en", True), (None, "de", True)]
    assert predict(docs.limit(0), model).collect() == []


def test_without_labels_all_is_unknown(spark):
    model = fit(spark.createDataFrame([], "text string, lang string"))
    out = predict(spark.createDataFrame([(1, "text")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


def test_held_out_accuracy(spark, sf):
    out = queries.op1_language_id(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
