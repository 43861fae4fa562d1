"""Files, versions, streams and plan shapes."""

import uuid

import pytest
from pyspark.sql import functions as F

import catalog
from catalog import fixtures as fx
from textkin.operators import relations, vectorize
from textkin.schemas import LABELS, METADATA
from textkin.session import shared_dir
from textkin.sources import files, metadata, sinks, tables
from textkin.streaming import ingest


@pytest.fixture
def scratch(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def test_unreadable_feature_records_are_set_aside(spark, scratch):
    good = '{"id":"a.1","features":{"pages":[{"seq":"00000001","body":{"tokenPosCount":{"The":{"DT":2,"NN":1},"the":{"DT":4}}}}]}}'
    spark.createDataFrame([(good,), ('{"id": broken',)], "value string").coalesce(1).write.text(scratch)
    f = tables.read_features(spark, scratch).cache()
    rows = tables.feature_tokens(f).collect()
    assert [(r["htid"], r["page"], r["token"], r["count"]) for r in rows] == [("a.1", 1, "the", 7)]
    assert tables.quarantine(f).count() == 1
    assert {r["token"] for r in tables.feature_tokens(f, lowercase=False).collect()} == {"The", "the"}


def test_versions_switch_on_commit_and_old_ones_stay(spark, scratch):
    a = spark.createDataFrame([("x", 1)], "htid string, n int")
    files.write_version(a, scratch, "htid")
    out = metadata.extend_store(spark, scratch, spark.createDataFrame([("x", 9)], "htid string, page_count int"))
    assert out.first()["page_count"] == 9
    assert files.versions(spark, scratch) == [1, 2]
    assert files.read_version(spark, scratch, 1).columns == ["htid", "n"]


def test_wrong_dimension_fails_the_job(spark):
    v = spark.createDataFrame([("a", 1, [1.0, 2.0])], "htid string, seq int, vec array<float>")
    assert vectorize.check_dims(v, 2).count() == 1
    with pytest.raises(Exception, match="expected 3 dimensions"):
        vectorize.check_dims(v, 3).select("vec").collect()


def test_record_lengths_are_checked(spark, scratch):
    spark.createDataFrame([("a", "b", [1.0], [1.0], [0] * 10)], "left string, right string, sim_x array<float>, wem_x array<float>, y array<int>").write.parquet(scratch)
    assert sinks.read_records(spark, scratch, 1, 1).collect()
    with pytest.raises(Exception, match="bad record"):
        sinks.read_records(spark, scratch, 4, 1).collect()


def test_stage_skips_volumes_already_saved(spark, scratch):
    first = spark.createDataFrame([("l.a", "old")], "htid string, v string")
    sinks.save_missing(first, scratch)
    both = spark.createDataFrame([("l.a", "new"), ("m.b", "new")], "htid string, v string")
    assert {(r["htid"], r["v"]) for r in sinks.save_missing(both, scratch).collect()} == {("l.a", "old"), ("m.b", "new")}
    assert {r["v"] for r in sinks.save_missing(both, scratch, force=True).collect()} == {"new"}


def test_forced_rewrite_keeps_the_other_volumes_of_a_library(spark, scratch):
    stage = spark.createDataFrame([("mdp.1", "old"), ("mdp.2", "old"), ("uc.1", "old")], "htid string, v string")
    sinks.save_missing(stage, scratch)
    out = sinks.save_missing(spark.createDataFrame([("mdp.1", "new")], "htid string, v string"), scratch, force=True)
    assert {(r["htid"], r["v"]) for r in out.collect()} == {("mdp.1", "new"), ("mdp.2", "old"), ("uc.1", "old")}


def test_quoted_dumps_and_years_as_floats(spark, scratch):
    head = ",".join(f.name for f in METADATA)
    names = [f.name for f in METADATA]
    row = {"htid": "a.1", "title": '"Works, ""vol"" 1"', "author": '"Smith, John"', "rights_date_used": "1999.0", "us_gov_doc_flag": "1"}
    good = ",".join(row.get(n, "") for n in names)
    bad = ",".join({"htid": "a.2", "rights_date_used": "soon"}.get(n, "") for n in names)
    spark.createDataFrame([("\n".join([head, good, bad]),)], "value string").coalesce(1).write.text(scratch)
    got = metadata.read_delimited(spark, scratch, sep=",", header=True).where("htid = 'a.1'").first()
    assert (got["title"], got["author"], got["rights_date_used"], got["us_gov_doc_flag"]) == ('Works, "vol" 1', "Smith, John", 1999, 1)
    lost = metadata.rejected_lines(spark, scratch, sep=",", header=True).collect()
    assert [r["htid"] for r in lost] == ["a.2"] and "soon" in lost[0]["line"]


def test_a_bad_record_fails_whichever_columns_are_read(spark, scratch):
    spark.createDataFrame([("a", "b", [1.0], [1.0], [0] * 10, "SWSM")], "left string, right string, sim_x array<float>, wem_x array<float>, y array<int>, judgment string").write.parquet(scratch)
    with pytest.raises(Exception, match="bad record"):
        sinks.read_records(spark, scratch, 4, 1).groupBy("judgment").count().collect()
    assert sinks.bad_records(spark.read.parquet(scratch), 4, 1).count() == 1


def test_ingest_reads_each_file_once_and_equals_batch(spark, sf, scratch):
    p = fx.predictions(spark, sf).withColumnRenamed("candidate", "htid").cache()
    ids = [r["target"] for r in p.select("target").distinct().orderBy("target").limit(6).collect()]
    root, table, sums, ckpt, base = (f"{scratch}/{n}" for n in ("in", "table", "sums", "ckpt", "base"))
    schema = p.drop("target").schema

    def put(some):
        for t in some:
            p.where(F.col("target") == t).drop("target").coalesce(1).write.parquet(f"{root}/{t}.predictions.parquet")

    def run():
        ingest.ingest(ingest.prediction_stream(spark, root, schema, files_per_batch=2), table, sums, ckpt).awaitTermination()

    put(ids[:4]); run(); run()
    ingest.compact(spark, sums, base)
    put(ids[4:]); run()
    want = relations.flip_judgments(p.withColumnRenamed("htid", "candidate").where(F.col("target").isin(ids)))
    got = spark.read.parquet(table)
    assert got.count() == want.count()
    key = ["target", "candidate", "flipped"]
    assert got.select(*key).exceptAll(want.select(*key)).isEmpty()
    means = {(r["target"], r["candidate"]): r["p_swsm"] for r in ingest.reciprocal_view(spark, sums, base, min_count=1).collect()}
    ref = {(r["target"], r["candidate"]): r["p_swsm"] for r in relations.reciprocal_means(want, min_count=1).collect()}
    assert means.keys() == ref.keys() and all(abs(means[k] - ref[k]) < 1e-12 for k in ref)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_point_lookup_and_columns_reach_the_scan(spark, sf, scratch):
    metadata.create_store(fx.meta(spark, sf), scratch)
    text = plan(metadata.get_volume(metadata.read_store(spark, scratch), "l1.000000000001", ["htid", "title"]))
    assert "EqualTo(htid,l1.000000000001)" in text and "ReadSchema: struct<htid:string,title:string>" in text


@pytest.mark.parametrize("name", [
    "a3_reciprocal_mean", "a5_cluster_means", "j22_same_author", "j24_rating_lists", "j26_similar_codes", "j27_similar_pairs", "c6_page_jaccard",
    "c11_matrix_stats", "u1_candidate_union", "p22_outlier_slice", "a20_structured_rows", "v8_recall_counts", "e7_islands",
])
def test_no_nested_loops_or_cross_products(spark, sf, name):
    text = plan(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_limits_groups_before_the_shuffle(spark, sf):
    text = plan(catalog.queries()["e11_cap_per_group"](spark, sf))
    assert "WindowGroupLimit" in text


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_tokens_of_feature_files_are_dealt_by_page(spark, tmp_path):
    """Pages are shuffled, not a row per token, and counts by volume need no further shuffle. A page may come in several records."""
    import json

    page = lambda n, **counts: {"seq": f"{n:08d}", "body": {"tokenPosCount": {k: v for k, v in counts.items()}}}
    rows = [{"id": "a", "features": {"pages": [page(1, The={"DT": 2, "NN": 1}, the={"DT": 4}, x={}), page(2, y={"NN": 1})]}},
            {"id": "a", "features": {"pages": [page(1, the={"DT": 1}), {"seq": "00000003"}]}}, {"id": "b", "features": {"pages": []}}]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, rows)))
    out = tables.feature_tokens(tables.read_features(spark, str(tmp_path)))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, "the", 8), ("a", 1, "x", 0), ("a", 2, "y", 1)]
    plan = out.groupBy("htid").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and min(i for i, line in enumerate(plan) if "explode(counts" in line) < shuffles[0]
