"""Nearest-neighbour joins and the candidates built on them (J18-J21, A1, A2, I1, I2, C20, L4, V8-V10)."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import q6, r6, sql
from catalog.joins import SHOPS, TRUTH, shops, truth
from catalog.sets import ring
from catalog.windows import chunk_ctes
from textkin.operators import candidates, evaluate, knn, vectorize
from textkin.operators import tokens as tk
from textkin.operators.bands import bands_sql
from textkin.session import cut, drop_bucketed

N = 12
DOC_DIST = 0.4


def chunks(spark, sf):
    return fx.chunk_vectors(spark, sf).select("htid", "seq", "vec")


def neighbours(spark, sf, n=N, max_dist=None, drop_self=False, **kw):
    c = chunks(spark, sf)
    return knn.chunk_neighbours(c, c, n, max_dist, drop_self=drop_self, **kw)


def doc_chunks(spark, sf, size=300, dims=64):
    """Hash-projection vectors of the documents' text chunks."""
    tokens = fx.token_table(spark, sf)
    out = cut(vectorize.hash_project(tk.chunk_token_list(tokens, size), dims=dims), "chunks")
    drop_bucketed(tokens)
    return out


_DOT = "list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])"
_NORM = "sqrt(list_dot_product({0}.vec::DOUBLE[], {0}.vec::DOUBLE[]))"
DIST = f"round(sqrt(greatest(0, 2 - 2 * {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}))), 7)"


def knn_sql(n, where="true"):
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, target_seq ORDER BY dist, match, match_seq) - 1 AS rank
  FROM (SELECT a.htid AS target, a.seq AS target_seq, b.htid AS match, b.seq AS match_seq, {DIST} AS dist
        FROM fx_chunk a, fx_chunk b) WHERE {where}) WHERE rank < {n}"""


BEST = """SELECT target, match, match_seq, min(dist) AS dist FROM nn GROUP BY ALL"""
EXT = "SELECT htid, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS length FROM fx_chunk GROUP BY htid"
DOCSTATS = """SELECT target, match, count, mean, m.length, count / t.length AS prop_target, count / m.length AS prop_match, t.length AS tl
  FROM (SELECT target, match, count(*) AS count, avg(dist) AS mean FROM best GROUP BY ALL)
  JOIN ext t ON t.htid = target JOIN ext m ON m.htid = match"""


def j18_exact_knn(spark, sf):
    return neighbours(spark, sf, drop_self=True).select("target", "target_seq", "match", "match_seq", "rank", r6("dist"))


def j18_exact_knn_cells(spark, sf):
    """The same search through pivot cells and distance bounds."""
    return neighbours(spark, sf, drop_self=True, pivots=8, max_dist=1.3).select(
        "target", "target_seq", "match", "match_seq", "rank", r6("dist"))


def j19_approximate_knn(spark, sf):
    """Search by bands of random hyperplanes, over document chunk vectors."""
    d = doc_chunks(spark, sf)
    return knn.chunk_neighbours(d, d, 10, max_dist=DOC_DIST, banded=True).select(
        "target", "target_seq", "match", "match_seq", "rank", r6("dist"))


def j19_nearest_cells(spark, sf):
    """Search of the nearest cells only, over document chunk vectors."""
    d = doc_chunks(spark, sf)
    return knn.chunk_neighbours(d, d, 10, max_dist=0.8, probes=3, pivots=12)


def j20_volume_knn(spark, sf):
    return knn.one_to_one(neighbours(spark, sf)).select("target", "match", "match_seq", "target_seq", r6("dist"))


def j21_title_candidates(spark, sf):
    return candidates.title_candidates(fx.meta(spark, sf))


def a1_doc_match_stats(spark, sf):
    c = chunks(spark, sf)
    s = candidates.doc_match_stats(neighbours(spark, sf, max_dist=1.25), candidates.volume_extents(c), min_count=2)
    return s.select("target", "match", "count", "length", r6("mean"), r6("prop_target"), r6("prop_match"))


def a2_volume_extents(spark, sf):
    return candidates.volume_extents(chunks(spark, sf))


def i1_ann_candidates(spark, sf):
    return candidates.ann_candidates(chunks(spark, sf), min_count=2, max_dist=1.25, min_prop_match=0.03).select(
        "target", "match", "count", "length", r6("mean"), r6("prop_target"), r6("prop_match"))


def i2_meta_candidates(spark, sf):
    return candidates.meta_candidates(fx.meta(spark, sf), max_author_results=20)


def c20_near_titles(spark, sf):
    return candidates.near_titles(fx.meta(spark, sf), cutoff=0.05, n=30).select("target", "match", r6("cos_dist"))


def l3_top_k(spark, sf):
    """The k nearest without an order among them."""
    return neighbours(spark, sf, n=5, drop_self=True).select("target", "target_seq", "match", "match_seq")


def l4_neighbour_votes(spark, sf):
    return knn.neighbour_votes(neighbours(spark, sf, n=10), minimum_matches=3)


def e1_neighbour_rank(spark, sf):
    return neighbours(spark, sf, max_dist=1.3).groupBy("rank").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


def e2_volume_rank(spark, sf):
    c = chunks(spark, sf)
    s = candidates.doc_match_stats(neighbours(spark, sf, max_dist=1.25), candidates.volume_extents(c))
    return evaluate.rank_matches(s.select(F.col("target").alias("left"), F.col("match").alias("right"), F.round("mean", 9).alias("mean"))).select(
        "left", "right", "rank")


def _matched(spark, sf):
    """Evaluation hook: volume matches of a table of targets."""
    c = chunks(spark, sf)

    def match(targets):
        wanted = c.join(targets, "htid", "left_semi")
        nn = knn.chunk_neighbours(wanted, c, N, 1.25, drop_self=False)
        return candidates.doc_match_stats(nn, candidates.volume_extents(c)).withColumnsRenamed(
            {"target": "left", "match": "right"})

    return match


def v8_recall_counts(spark, sf):
    t = chunks(spark, sf).select("htid").distinct()
    counts, _ = evaluate.run_evaluation(t, _matched(spark, sf), truth(spark, sf), shops(spark, sf), "n12")
    return counts


def v8_false_positives(spark, sf):
    t = chunks(spark, sf).select("htid").distinct()
    _, wrong = evaluate.run_evaluation(t, _matched(spark, sf), truth(spark, sf), shops(spark, sf), "n12")
    return wrong


def v9_condition_sweep(spark, sf):
    c = chunks(spark, sf)
    cond = [("n5", 5, 1.3, 1), ("n10", 10, 1.3, 1), ("n10c2", 10, 1.3, 2), ("n12d", 12, 1.2, 1)]
    return evaluate.sweep(neighbours(spark, sf), candidates.volume_extents(c), cond).groupBy("condition").agg(
        F.count("*").alias("pairs"), F.sum("count").alias("matches"), r6(F.avg("mean"), "mean"))


def v10_recall_by_band(spark, sf):
    """Neighbours of document chunks that the banded search finds, of those that the exact one lists."""
    d = doc_chunks(spark, sf)
    exact = knn.chunk_neighbours(d, d, 10, max_dist=DOC_DIST).withColumn("sim", knn.similarity(F.col("dist")))
    approx = knn.chunk_neighbours(d, d, 10, max_dist=DOC_DIST, banded=True)
    return evaluate.recall_by_band(exact, approx, ["target", "target_seq", "match", "match_seq"], edge=0.95).withColumn("recall", r6("recall"))


QUERIES = {f.__name__: f for f in (
    j18_exact_knn, j18_exact_knn_cells, j19_approximate_knn, j19_nearest_cells, j20_volume_knn, j21_title_candidates, a1_doc_match_stats,
    a2_volume_extents, i1_ann_candidates, i2_meta_candidates, c20_near_titles, l3_top_k, l4_neighbour_votes,
    e1_neighbour_rank, e2_volume_rank, v8_recall_counts, v8_false_positives, v9_condition_sweep, v10_recall_by_band)}

# Neighbours of document chunks: all, and those that share a bucket.
_DOC = {
    **chunk_ctes(300),
    "counts": """SELECT t.htid, seq, token, CAST(sum(count) AS BIGINT) AS n FROM fx_token t JOIN chunk_pages p ON p.htid = t.htid AND p.page = t.page GROUP BY ALL""",
    "comps": f"""SELECT htid, seq, pos, CAST(sum(ln(1 + n) * {fx.sign_sql()}) AS FLOAT)::DOUBLE AS x
      FROM (SELECT htid, seq, n, sha1(token || '#0') AS h, unnest(range(0, 64)) AS pos FROM counts) GROUP BY htid, seq, pos""",
    "vecs": "SELECT htid, seq, list(x ORDER BY pos) AS vec, sqrt(sum(x * x)) AS n FROM comps GROUP BY htid, seq",
    "cells": f"SELECT htid, seq, unnest({bands_sql(64, DOC_DIST)}) AS cell FROM vecs",
    "near": f"""SELECT * FROM (SELECT a.htid AS target, a.seq AS target_seq, b.htid AS match, b.seq AS match_seq,
        round(sqrt(greatest(0, 2 - 2 * list_dot_product(a.vec, b.vec) / (a.n * b.n))), 7) AS dist FROM vecs a, vecs b
      WHERE a.htid <> b.htid OR a.seq <> b.seq) WHERE dist <= {DOC_DIST}""",
    "met": """SELECT DISTINCT a.htid AS target, a.seq AS target_seq, b.htid AS match, b.seq AS match_seq FROM cells a JOIN cells b ON a.cell = b.cell""",
    "top": """SELECT *, row_number() OVER (PARTITION BY target, target_seq ORDER BY dist, match, match_seq) - 1 AS rank FROM near QUALIFY rank < 10""",
    "found": """SELECT near.*, row_number() OVER (PARTITION BY target, target_seq ORDER BY dist, match, match_seq) - 1 AS rank
      FROM near JOIN met USING (target, target_seq, match, match_seq) QUALIFY rank < 10""",
}
_NOT_SELF = "(target <> match OR target_seq <> match_seq)"
_STATS = {"nn": knn_sql(N, "true"), "best": BEST.replace("FROM nn", "FROM nn WHERE dist <= 1.25"), "ext": EXT, "ds": DOCSTATS}
_DS_COLS = f"target, match, count, length, {q6('mean')}, {q6('prop_target')}, {q6('prop_match')}"
_EVAL = {**_STATS, "shops": SHOPS, "truth0": TRUTH,
         "truth": "SELECT * FROM truth0 WHERE judgment NOT IN ('RANDDIFF', 'AUTHOR')",
         "res": 'SELECT target AS "left", match AS "right" FROM ds',
         "author_gt": """SELECT l.htid AS "left", r.htid AS "right", 'author' AS judgment FROM shops l JOIN shops r
           ON l.author = r.author AND l.htid <> r.htid WHERE l.htid IN (SELECT "left" FROM truth)
           AND NOT EXISTS (SELECT 1 FROM truth g WHERE g."left" = l.htid AND g."right" = r.htid)""",
         "full_gt": 'SELECT * FROM truth UNION ALL SELECT * FROM author_gt'}

_TITLE = """SELECT match, target, 'meta' AS note FROM tn WHERE dist <= 0.35 AND target <> match AND (rank < 25 OR rank < 100 AND target IN
  (SELECT target FROM tn WHERE rank = 24 AND dist < 0.3))"""

ORACLE = {
    "j19_approximate_knn": sql(f"SELECT target, target_seq, match, match_seq, rank, {q6('dist')} FROM found", "fx_token", **_DOC),
    "v10_recall_by_band": sql(f"""SELECT CASE WHEN 1 - dist * dist / 2 > 0.95 THEN '> 0.95' ELSE '<= 0.95' END AS band, count(*) AS neighbours,
        count(hit) AS found, {q6('count(hit) / count(*)', 'recall')} FROM top LEFT JOIN (SELECT target, target_seq, match, match_seq, 1 AS hit FROM found)
        USING (target, target_seq, match, match_seq) GROUP BY 1""", "fx_token", **_DOC),
    "j21_title_candidates": sql(_TITLE, "fx_meta", **fx.title_views(max_dist=0.35)),
    "i2_meta_candidates": sql(f"SELECT target, match, 'author' AS note FROM {ring('author', 20)} UNION ALL SELECT target, match, note FROM ({_TITLE})",
                              "fx_meta", **fx.title_views(max_dist=0.35)),
    "c20_near_titles": sql(f"""SELECT target, match, {q6('dist * dist / 2', 'cos_dist')} FROM (SELECT *, row_number() OVER (PARTITION BY target
        ORDER BY dist, match) AS r FROM tn WHERE target <> match) WHERE r <= 30 AND dist * dist / 2 < 0.05""",
        "fx_meta", **fx.title_views(max_dist=0.1 ** 0.5)),
    "j18_exact_knn": sql(f"SELECT target, target_seq, match, match_seq, rank, {q6('dist')} FROM nn", "fx_chunk", nn=knn_sql(N, _NOT_SELF)),
    "j18_exact_knn_cells": sql(f"SELECT target, target_seq, match, match_seq, rank, {q6('dist')} FROM nn WHERE dist <= 1.3", "fx_chunk", nn=knn_sql(N, _NOT_SELF)),
    "j20_volume_knn": sql(f"""SELECT target, match, match_seq, target_seq, {q6('dist')} FROM nn
        QUALIFY row_number() OVER (PARTITION BY target, match, match_seq ORDER BY dist, target_seq) = 1""", "fx_chunk", nn=knn_sql(N)),
    "a1_doc_match_stats": sql(f"SELECT {_DS_COLS} FROM ds WHERE count >= least(2, tl)", "fx_chunk", **_STATS),
    "a2_volume_extents": sql(EXT, "fx_chunk"),
    "i1_ann_candidates": sql(f"SELECT {_DS_COLS} FROM ds WHERE count >= least(2, tl) AND prop_match >= 0.03 AND target <> match", "fx_chunk", **{**_STATS, "nn": knn_sql(300)}),
    "l3_top_k": sql("SELECT target, target_seq, match, match_seq FROM nn", "fx_chunk", nn=knn_sql(5, _NOT_SELF)),
    "l4_neighbour_votes": sql("""SELECT target, match, hits FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY hits DESC, match) AS r
          FROM (SELECT target, match, count(*) AS hits FROM nn GROUP BY target, match))
        WHERE r <= 10 AND hits > 3 AND match <> target""", "fx_chunk", nn=knn_sql(10)),
    "e1_neighbour_rank": sql("""SELECT CAST(rank AS INTEGER) AS rank, count(*) AS n, count(DISTINCT target) AS targets FROM nn WHERE dist <= 1.3 GROUP BY rank""", "fx_chunk", nn=knn_sql(N)),
    "e2_volume_rank": sql("""SELECT target AS "left", match AS "right", row_number() OVER (PARTITION BY target ORDER BY round(mean, 9), match) AS rank
        FROM ds""", "fx_chunk", **_STATS),
    "v8_recall_counts": sql("""SELECT "left", judgment, count(*) FILTER (hit IS NULL) AS false_negatives, count(hit) AS true_positives,
        'n12' AS condition FROM full_gt LEFT JOIN (SELECT *, 1 AS hit FROM res) USING ("left", "right") GROUP BY ALL""", "fx_chunk", **_EVAL),
    "v8_false_positives": sql("""SELECT "left", (SELECT count(*) FROM res r WHERE r."left" = t."left" AND r."right" <> t."left"
          AND NOT EXISTS (SELECT 1 FROM full_gt g WHERE g."left" = r."left" AND g."right" = r."right")) AS false_positives,
        'n12' AS condition FROM (SELECT DISTINCT "left" FROM truth) t""", "fx_chunk", **_EVAL),
    "v9_condition_sweep": sql(f"""SELECT condition, count(*) AS pairs, CAST(sum(count) AS BIGINT) AS matches, {q6('avg(mean)', 'mean')} FROM (
          SELECT condition, target, match, count(*) AS count, avg(dist) AS mean, any_value(min_count) AS mc FROM (
            SELECT condition, min_count, target, match, match_seq, min(dist) AS dist FROM nn, cond
            WHERE rank < n AND dist <= max_dist GROUP BY ALL) GROUP BY condition, target, match)
        JOIN ext ON htid = target WHERE count >= least(mc, length) GROUP BY condition""", "fx_chunk", nn=knn_sql(N), ext=EXT,
        cond="SELECT * FROM (VALUES ('n5', 5, 1.3::DOUBLE, 1), ('n10', 10, 1.3, 1), ('n10c2', 10, 1.3, 2), ('n12d', 12, 1.2, 1)) t(condition, n, max_dist, min_count)"),
}
