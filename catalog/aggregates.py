"""Aggregations (A), apart from A1, A2 (neighbours) and A20 (scoring)."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import q6, q6s, r6, r6s, sql
from catalog.joins import CLEAN, CLUSTERS, STATS_BY_WORK, WORK_PAIRS, KEYED, _keyed, _links, _work_predictions, clusters, rel
from textkin.functions import ids
from textkin.operators import crosswalk, graph, relations, synthesis, vectorize
from textkin.operators import tokens as tk
from textkin.schemas import LABELS


def a3_reciprocal_mean(spark, sf):
    return relations.reciprocal_means(relations.flip_judgments(rel(spark, sf))).select(
        "target", "candidate", "count", *r6s(*LABELS))


def a4_disagreement(spark, sf):
    return relations.reciprocal_means(relations.flip_judgments(rel(spark, sf)), include_std=True).select(
        "target", "candidate", r6("std_diff"))


def a5_cluster_means(spark, sf):
    return _work_predictions(spark, sf).select("target", "candidate", "count", *r6s(*LABELS))


def a6_cluster_stats(spark, sf):
    return graph.cluster_stats(clusters(spark, sf), fx.meta(spark, sf), "work_id").select(
        "work_id", "label_count", "gov_count", "serial_count", *r6s("gov_prop", "serial_prop"))


def a7_top_targets(spark, sf):
    return relations.top_ids(rel(spark, sf), "target", 500)


def a8_counts_by_title(spark, sf):
    top = relations.with_metadata(relations.top_ids(rel(spark, sf), "candidate", 500), fx.meta(spark, sf), ["title"], side="candidate")
    return top.groupBy("title").agg(F.sum("count").alias("count"))


def a9_distinct_counts(spark, sf):
    r = rel(spark, sf)
    return r.agg(F.count("*").alias("rows"), F.count_distinct("target").alias("targets"), F.count_distinct("candidate").alias("candidates"))


def a10_edition_counts(spark, sf):
    return fx.meta(spark, sf).groupBy("author", "title", "imprint").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "author", "title", "imprint").offset(20).limit(200)


def a11_group_filter(spark, sf):
    m = fx.meta(spark, sf)
    return synthesis.groups_having(m, ["author", "title"], F.count_distinct("description") > 1).select("htid", "author", "title")


def a12_token_sets(spark, sf):
    return tk.token_sets(fx.tokens(spark, sf)).groupBy("htid", "page").agg(F.count("*").alias("members"))


def a13_page_totals(spark, sf):
    return tk.page_totals(fx.tokens(spark, sf))


def a14_mean_vectors(spark, sf):
    m = vectorize.mean_vectors(fx.chunk_vectors(spark, sf))
    return m.select("htid", F.posexplode("vec").alias("pos", "x")).select("htid", "pos", r6("x"))


def a15_sum_and_median(spark, sf):
    c = fx.chunk_vectors(spark, sf)
    s = vectorize.sum_vectors(c, ["label"]).select("label", F.posexplode("vec").alias("pos", "x"))
    m = vectorize.median_components(c, ["label"])
    return s.withColumnRenamed("x", "total").join(m, ["label", "pos"]).select("label", "pos", r6("total"), r6("x", "median"))


def a16_quantiles(spark, sf):
    l = fx.table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_extendedprice").alias("x")).agg(F.count("*").alias("c"))
    q = vectorize.weighted_quantiles(l, ["l_returnflag"], "x", "c", [0.1, 0.25, 0.4, 0.5, 0.75, 0.9, 0.95, 0.99])
    return q.select("l_returnflag", r6("q"), r6("value"))


def a17_value_counts(spark, sf):
    return clusters(spark, sf).groupBy("man_id").agg(F.count("*").alias("n")).where("n > 1")


def a18_zscore_profile(spark, sf):
    from textkin.operators.score import zscore_profile

    l = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cluster"), "l_quantity", "l_discount", "l_extendedprice")
    return zscore_profile(l, "cluster", ["l_quantity", "l_discount", "l_extendedprice"]).select(
        "cluster", *r6s("z_l_quantity", "z_l_discount", "z_l_extendedprice"))


def a19_merged_metadata(spark, sf):
    """Synthetic volumes: one per order, made of the parts on its lines."""
    parts = fx.lines(spark, sf).select(
        F.col("l_orderkey").alias("new_id"), F.col("l_linenumber").alias("part_no"), fx.volume_id("part").alias("htid"))
    out = synthesis.merge_metadata(parts, fx.meta(spark, sf))
    return out.select("new_id", "names", "pub_date", "title", "source_htids", "page_count", "fake_id")


def a21_distinct_code_links(spark, sf):
    b, v = crosswalk.align(*_keyed(spark, sf))
    return crosswalk.similar_codes(b, _links(spark, sf))


def a22_distinct_authors_titles(spark, sf):
    v = crosswalk.volume_keys(fx.meta(spark, sf))
    return v.select(F.lit("author").alias("kind"), F.col("clean_author").alias("value")).unionByName(
        v.select(F.lit("title").alias("kind"), F.col("simple_title").alias("value"))).distinct()


def a23_disagreement_ranking(spark, sf):
    s = relations.reciprocal_means(relations.flip_judgments(rel(spark, sf)), include_std=True)
    return s.select("target", "candidate", F.round("std_diff", 9).alias("s")).orderBy(F.desc("s"), "target", "candidate").limit(100).select(
        "target", "candidate", r6("s", "std_diff"))


QUERIES = {f.__name__: f for f in (
    a3_reciprocal_mean, a4_disagreement, a5_cluster_means, a6_cluster_stats, a7_top_targets, a8_counts_by_title,
    a9_distinct_counts, a10_edition_counts, a11_group_filter, a12_token_sets, a13_page_totals, a14_mean_vectors,
    a15_sum_and_median, a16_quantiles, a17_value_counts, a18_zscore_profile, a19_merged_metadata,
    a21_distinct_code_links, a22_distinct_authors_titles, a23_disagreement_ranking)}

_STD = " + ".join(f"stddev_pop({c})" for c in LABELS)
STD = CLEAN.replace("count(*) AS count", f"({_STD}) AS std_diff, count(*) AS count")

ORACLE = {
    "a3_reciprocal_mean": sql(f"SELECT target, candidate, count, {q6s(*LABELS)} FROM clean", "fx_rel", clean=CLEAN),
    "a4_disagreement": sql(f"SELECT target, candidate, {q6('std_diff')} FROM s", "fx_rel", s=STD),
    "a5_cluster_means": sql(f"SELECT target, candidate, count, {q6s(*LABELS)} FROM wp", "fx_rel", "fx_meta", clusters=CLUSTERS, clean=CLEAN, wp=WORK_PAIRS),
    "a6_cluster_stats": sql(f"SELECT work_id, label_count, gov_count, serial_count, {q6s('gov_prop', 'serial_prop')} FROM st", "fx_meta", clusters=CLUSTERS, st=STATS_BY_WORK),
    "a7_top_targets": sql("SELECT target, count(*) AS count FROM fx_rel GROUP BY target ORDER BY count DESC, target LIMIT 500", "fx_rel"),
    "a8_counts_by_title": sql("""SELECT title, CAST(sum(count) AS BIGINT) AS count FROM (SELECT candidate, count(*) AS count FROM fx_rel
        GROUP BY candidate ORDER BY count DESC, candidate LIMIT 500) JOIN fx_meta ON htid = candidate GROUP BY title""", "fx_rel", "fx_meta"),
    "a9_distinct_counts": sql("SELECT count(*) AS rows, count(DISTINCT target) AS targets, count(DISTINCT candidate) AS candidates FROM fx_rel", "fx_rel"),
    "a10_edition_counts": sql("""SELECT author, title, imprint, count(*) AS n FROM fx_meta GROUP BY ALL
        ORDER BY n DESC, author, title, imprint LIMIT 200 OFFSET 20""", "fx_meta"),
    "a11_group_filter": sql("""SELECT htid, author, title FROM fx_meta WHERE (author, title) IN (SELECT (author, title) FROM fx_meta
        GROUP BY author, title HAVING count(DISTINCT description) > 1)""", "fx_meta"),
    "a12_token_sets": sql("SELECT htid, CAST(page AS INTEGER) AS page, count(DISTINCT token) AS members FROM fx_token GROUP BY ALL", "fx_token"),
    "a13_page_totals": sql("SELECT htid, CAST(page AS INTEGER) AS page, CAST(sum(count) AS BIGINT) AS n_tokens FROM fx_token GROUP BY ALL", "fx_token"),
    "a14_mean_vectors": sql(f"""SELECT htid, pos, {q6('avg(x)', 'x')} FROM (SELECT htid, unnest(vec)::DOUBLE AS x,
        CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos FROM fx_chunk) GROUP BY ALL""", "fx_chunk"),
    "a15_sum_and_median": sql(f"""SELECT label, pos, {q6('sum(x)', 'total')}, {q6('quantile_cont(x, 0.5)', 'median')} FROM (SELECT label, unnest(vec)::DOUBLE AS x,
        CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos FROM fx_chunk) GROUP BY ALL""", "fx_chunk"),
    "a16_quantiles": f"""SELECT l_returnflag, {q6('q::DOUBLE', 'q')}, {q6('v', 'value')} FROM (SELECT l_returnflag,
        unnest([0.1, 0.25, 0.4, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q,
        unnest(quantile_cont(l_extendedprice, [0.1, 0.25, 0.4, 0.5, 0.75, 0.9, 0.95, 0.99])) AS v FROM lineitem GROUP BY l_returnflag)""",
    "a17_value_counts": sql("SELECT man_id, count(*) AS n FROM clusters GROUP BY man_id HAVING count(*) > 1", "fx_meta", clusters=CLUSTERS),
    "a18_zscore_profile": f"""SELECT l_returnflag AS cluster, {", ".join(q6(f"avg(({c} - m_{c}) / s_{c})", "z_" + c) for c in ("l_quantity", "l_discount", "l_extendedprice"))}
        FROM lineitem, (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("l_quantity", "l_discount", "l_extendedprice"))} FROM lineitem)
        GROUP BY l_returnflag""",
    "a19_merged_metadata": sql("""SELECT new_id, string_agg(DISTINCT author, '; ' ORDER BY author) AS names,
        round(avg(rights_date_used) + 1e-10, 6) AS pub_date,
        'Fake Anthology: ' || string_agg((k - 1) || ') ' || substr(title, 1, 40) || '...', '' ORDER BY part_no) AS title,
        string_agg(htid, ',' ORDER BY part_no) AS source_htids, CAST(sum(page_count) AS BIGINT) AS page_count,
        'fake.' || substr(md5(string_agg(htid, ',' ORDER BY part_no)), 1, 6) AS fake_id
        FROM (SELECT l_orderkey AS new_id, l_linenumber AS part_no, fx_meta.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k
              FROM fx_lines JOIN fx_meta ON key = part) GROUP BY new_id""", "fx_lines", "fx_meta"),
    "a21_distinct_code_links": sql("SELECT code, similar_code FROM codes", "fx_meta", "fx_books", "fx_edges", **KEYED),
    "a22_distinct_authors_titles": sql(r"""SELECT DISTINCT 'author' AS kind, author AS value FROM fx_meta UNION
        SELECT DISTINCT 'title', regexp_replace(lower(title), '[^\p{L}\p{N}_]', '', 'g') FROM fx_meta""", "fx_meta"),
    "a23_disagreement_ranking": sql(f"""SELECT target, candidate, {q6('s', 'std_diff')} FROM (SELECT target, candidate, round(std_diff, 9) AS s FROM t)
        ORDER BY s DESC, target, candidate LIMIT 100""", "fx_rel", t=STD),
}
