"""Pairwise comparison operators (C, J29, L9)."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import q6, r6, r6s, sql
from catalog.joins import next_books
from catalog.sets import ring
from textkin.functions.vectors import set_jaccard
from textkin.operators import align, candidates, compare
from textkin.session import bucketed, cut, drop_bucketed, shuffle_parts


def chunks(spark, sf):
    return fx.chunk_vectors(spark, sf).select("htid", "seq", "vec")


def c1_distance_cells(spark, sf):
    return compare.distance_cells(next_books(spark, sf), chunks(spark, sf)).select(
        "left", "right", "left_seq", "right_seq", r6("dist"))


def c2_recentred_cells(spark, sf):
    return compare.recentred_cells(next_books(spark, sf), chunks(spark, sf)).select(
        "left", "right", "left_seq", "right_seq", F.round(F.col("dist") + 1e-10, 5).alias("dist"))


def c3_median_centred(spark, sf):
    return compare.median_centred_dots(next_books(spark, sf), chunks(spark, sf)).select(
        "left", "right", "left_seq", "right_seq", F.round(F.col("sim") + 1e-10, 5).alias("sim"))


def c4_similarity_cells(spark, sf):
    return compare.similarity_cells(next_books(spark, sf), chunks(spark, sf)).select(
        "left", "right", "left_seq", "right_seq", r6("sim"))


def c5_unrolled_matrix(spark, sf):
    m = compare.unrolled_matrix(next_books(spark, sf), chunks(spark, sf), 12)
    return m.select("left", "right", F.posexplode("sim_x").alias("i", "x")).select(
        "left", "right", "i", F.round(F.col("x").cast("double") + 1e-9, 4).alias("x"))


def doc_cells(spark, sf, drop_common=20):
    """Page Jaccard cells of the document pairs, written once: several operators read them."""
    return cells_and_pages(spark, sf, drop_common)[0]


def cells_and_pages(spark, sf, drop_common=20):
    """The cells, and the pages that hold tokens, from one token table; tokens and page sets go once both are written."""
    t = fx.token_table(spark, sf)
    pages = cut(compare.page_index(t).select("htid", "idx", "n_tokens"), "pages")
    sets = bucketed(compare.page_sets(t), "sets", ["htid"], shuffle_parts(spark), dealt=True)
    drop_bucketed(t)
    cells = cut(compare.jaccard_cells(fx.doc_pairs(spark, sf), sets, drop_common), "cells")
    drop_bucketed(sets)
    return cells, pages


def page_sizes(pages):
    return pages.groupBy("htid").agg(F.count("*").alias("n"))


def c6_page_jaccard(spark, sf):
    return doc_cells(spark, sf).select("left", "right", "left_seq", "right_seq", r6("sim"))


def c7_score_matrix(spark, sf):
    """Scores of the local alignment of every document pair's pages."""
    return align.score_cells(doc_cells(spark, sf), threshold=0.2).select("left", "right", "left_seq", "right_seq", r6("score"))


def c7_alignment_runs(spark, sf):
    return align.alignment_runs(doc_cells(spark, sf), threshold=0.2, min_length=3)


def c10_run_lengths(spark, sf):
    p, c = next_books(spark, sf), chunks(spark, sf)
    cells = cut(compare.similarity_cells(p, c), "cells")
    return align.run_lengths(p, cells, [0.1, 0.2, 0.3, 0.4])


def c11_matrix_stats(spark, sf):
    return compare.matrix_stats(next_books(spark, sf), chunks(spark, sf), thresholds=[0.7, 0.8]).select(
        "left", "right", "l_size", "r_size", "min_size", *r6s(*C11_VALUES))


C11_VALUES = ["mean_dist", "l_mean_min_dist", "r_mean_min_dist", "l_trunc_dist", "r_trunc_dist",
              "l_prop_dist_0700", "r_prop_dist_0700", "l_prop_dist_0800", "r_prop_dist_0800"]


def c12_margin_quantiles(spark, sf):
    q = compare.margin_quantiles(next_books(spark, sf), chunks(spark, sf))
    return q.select("left", "right", *r6s(*[f"{s}_quantile_{i}" for s in "lr" for i in range(10)]))


def c13_page_counts(spark, sf):
    p = fx.predictions(spark, sf).select(F.col("target").alias("left"), F.col("candidate").alias("right"))
    return compare.page_count_stats(p, fx.meta(spark, sf)).select(
        "left", "right", "left_page_count", "right_page_count", "page_diff", r6("page_prop_diff"))


def c14_all_stats(spark, sf):
    from textkin.plans.features import pair_statistics

    return pair_statistics(next_books(spark, sf), chunks(spark, sf), others={"half": halves(spark, sf)})


def halves(spark, sf):
    """Another kind of vectors of the same chunks: the first half of their components."""
    return chunks(spark, sf).withColumn("vec", F.slice("vec", 1, 32))


def c14_two_kinds(spark, sf):
    """The distance statistics and the quantiles of both kinds of vectors."""
    from textkin.plans.features import pair_statistics

    s = pair_statistics(next_books(spark, sf), chunks(spark, sf), distance_thresholds=[0.7, 0.8], others={"half": halves(spark, sf)})
    return s.select("left", "right", "l_size", "r_size", "min_size", *r6s(*C11_VALUES), *r6s(
        *[f"{k}{x}_quantile_{i}" for k in ("", "half_") for x in "lr" for i in range(10)]))


def c5_unrolled_jaccard(spark, sf):
    m = compare.unrolled_cells(fx.doc_pairs(spark, sf), doc_cells(spark, sf), 6)
    return m.select("left", "right", F.posexplode("sim_x").alias("i", "x")).select(
        "left", "right", "i", F.round(F.col("x").cast("double") + 1e-9, 4).alias("x"))


def x2_cells_where(spark, sf):
    """Cells of the distance matrices under a predicate."""
    cells = compare.cells_where(compare.distance_cells(next_books(spark, sf), chunks(spark, sf)), lambda d: (d < 0.8) | (d > 1.2))
    return cells.select("left", "right", "left_seq", "right_seq", r6("dist"))


def c15_run_statistics(spark, sf):
    cells, pages = cells_and_pages(spark, sf)
    runs = align.alignment_runs(cells, threshold=0.2)
    return align.run_statistics(runs, cells, page_sizes(pages))


def c16_run_slopes(spark, sf):
    cells, pages = cells_and_pages(spark, sf)
    return align.run_slopes(align.alignment_runs(cells, threshold=0.2), pages)


def c17_mean_vector_features(spark, sf):
    p = next_books(spark, sf)
    out = None
    for form in ("mean_diff", "concat"):
        part = compare.mean_vector_features(p, chunks(spark, sf), form).select(
            "left", "right", F.lit(form).alias("form"), F.posexplode("wem_x").alias("pos", "x"))
        out = part if out is None else out.unionByName(part)
    return out.select("left", "right", "form", "pos", r6("x"))


def c18_derived_stats(spark, sf):
    s = compare.matrix_stats(next_books(spark, sf), chunks(spark, sf), thresholds=[0.8]).withColumn(
        "sw_0005_len", F.col("l_size") * 2)
    d = compare.derived_stats(s)
    return d.select("left", "right", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in d.columns if c not in ("left", "right")])


def c19_title_distances(spark, sf):
    """Title distance of every volume to others by its author."""
    m = fx.meta(spark, sf)
    p = candidates.same_author_candidates(m, max_results=5).select(F.col("target").alias("left"), F.col("match").alias("right"))
    return candidates.title_distances(p, m).select("left", "right", r6("title_distance"))


def f13_set_jaccard(spark, sf):
    """Set Jaccard of the (at most seven) lines of neighbouring orders."""
    l = fx.lines(spark, sf).groupBy("l_orderkey").agg(F.collect_set(F.col("part") % 20).alias("m"))
    nxt = l.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("m").alias("m2"))
    return l.join(nxt, "l_orderkey").select("l_orderkey", r6(set_jaccard(F.col("m"), F.col("m2")), "jaccard"))


def j29_runs_with_words(spark, sf):
    """Matched cells with the running token counts of both pages."""
    from textkin.operators.ranks import running_total

    cells, pages = cells_and_pages(spark, sf)
    words = running_total(pages, ["htid"], "idx", "n_tokens", "words").select("htid", "idx", "words")
    cells = cells.where("sim > 0.2")
    return cells.join(words.toDF("left", "left_seq", "left_words"), ["left", "left_seq"]).join(
        words.toDF("right", "right_seq", "right_words"), ["right", "right_seq"]).select(
        "left", "right", "left_seq", "right_seq", "left_words", "right_words")


def l9_four_points(spark, sf):
    cells, pages = cells_and_pages(spark, sf)
    f = compare.four_points(fx.doc_pairs(spark, sf), cells, page_sizes(pages))
    return f.select("left", "right", *r6s("sim_at_quarter_length", "sim_at_half_length", "sim_at_full_length", "sim_at_double_length"))


QUERIES = {f.__name__: f for f in (
    c1_distance_cells, c2_recentred_cells, c3_median_centred, c4_similarity_cells, c5_unrolled_matrix, c6_page_jaccard,
    c7_score_matrix, c7_alignment_runs, c10_run_lengths, c11_matrix_stats, c12_margin_quantiles, c13_page_counts, c14_all_stats,
    c15_run_statistics, c16_run_slopes, c17_mean_vector_features, c18_derived_stats, c19_title_distances, f13_set_jaccard,
    j29_runs_with_words, l9_four_points, c5_unrolled_jaccard, c14_two_kinds, x2_cells_where)}

PAIRS = """SELECT DISTINCT a.htid AS "left", b.htid AS "right" FROM fx_chunk a JOIN fx_chunk b
  ON CAST(substr(b.htid, 3) AS BIGINT) = CAST(substr(a.htid, 3) AS BIGINT) + 1"""
CELLS = """SELECT "left", "right", l.seq AS left_seq, r.seq AS right_seq,
  1 - list_cosine_similarity(l.vec::DOUBLE[], r.vec::DOUBLE[]) AS dist
  FROM pairs JOIN fx_chunk l ON l.htid = "left" JOIN fx_chunk r ON r.htid = "right\""""
_CELLS = {"pairs": PAIRS, "cells": CELLS}
LONG = """SELECT htid, seq, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS pos FROM fx_chunk"""
CENTRED = """SELECT "left", "right", side, seq, list(x - c ORDER BY pos) AS vec FROM (
  SELECT p.*, 'L' AS side, seq, x, pos FROM pairs p JOIN long ON htid = "left"
  UNION ALL SELECT p.*, 'R', seq, x, pos FROM pairs p JOIN long ON htid = "right") JOIN center USING ("left", "right", pos) GROUP BY ALL"""
MARGINS = """SELECT "left", "right", 'l' AS side, left_seq AS seq, min(dist) AS d FROM cells GROUP BY ALL
  UNION ALL SELECT "left", "right", 'r', right_seq, min(dist) FROM cells GROUP BY ALL"""
RANKED = """SELECT *, row_number() OVER (PARTITION BY "left", "right", side ORDER BY d, seq) AS rn FROM margins"""
SIZES = """SELECT "left", "right", count(DISTINCT left_seq) AS nl, count(DISTINCT right_seq) AS nr, avg(dist) AS mean_dist FROM cells GROUP BY ALL"""


def _stats_sql(thresholds):
    cols = []
    for s in "lr":
        cols += [f"avg(d) FILTER (side = '{s}') AS {s}_mean_min_dist",
                 f"avg(d) FILTER (side = '{s}' AND rn <= least(nl, nr)) AS {s}_trunc_dist"]
        cols += [f"avg(CAST(d < {t} AS DOUBLE)) FILTER (side = '{s}') AS {s}_prop_dist_{round(t * 1000):04d}" for t in thresholds]
    return f"""SELECT "left", "right", nl AS l_size, nr AS r_size, least(nl, nr) AS min_size, mean_dist, {", ".join(cols)}
      FROM ranked JOIN sizes USING ("left", "right") GROUP BY ALL"""


_QUANTILES = ", ".join(q6(f"quantile_cont(d, {i / 10}) FILTER (side = '{s}')", "{p}" + f"{s}_quantile_{i}") for s in "lr" for i in range(10))
_STATS = {**_CELLS, "margins": MARGINS, "ranked": RANKED, "sizes": SIZES}
JACC = {
    "pages": """SELECT htid, page, row_number() OVER (PARTITION BY htid ORDER BY page) - 1 AS idx, CAST(sum(n) AS BIGINT) AS n_tokens,
      CAST(sum(sum(n)) OVER (PARTITION BY htid ORDER BY page) AS BIGINT) AS words FROM (SELECT htid, page, sum(count) AS n FROM fx_token GROUP BY ALL) GROUP BY htid, page""",
    "sets": "SELECT t.htid, idx, token FROM fx_token t JOIN pages USING (htid, page)",
    "members": """SELECT p.*, 'L' AS side, idx, token FROM fx_pairs p JOIN sets ON htid = "left"
      UNION ALL SELECT p.*, 'R', idx, token FROM fx_pairs p JOIN sets ON htid = "right\"""",
    "common": """SELECT "left", "right", token FROM (SELECT "left", "right", token, count(*) AS df FROM members GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY "left", "right" ORDER BY df DESC, token) <= 20""",
    "kept": """SELECT m.* FROM members m ANTI JOIN common USING ("left", "right", token)""",
    "pagesize": """SELECT "left", "right", side, idx, count(*) AS n FROM kept GROUP BY ALL""",
    "jcells": """SELECT i.*, inter / greatest(a.n + b.n - inter, 1) AS sim FROM (
      SELECT l."left", l."right", l.idx AS left_seq, r.idx AS right_seq, count(*) AS inter FROM kept l JOIN kept r
      ON l."left" = r."left" AND l."right" = r."right" AND l.token = r.token AND l.side = 'L' AND r.side = 'R' GROUP BY ALL) i
      JOIN pagesize a ON a."left" = i."left" AND a."right" = i."right" AND a.side = 'L' AND a.idx = left_seq
      JOIN pagesize b ON b."left" = i."left" AND b."right" = i."right" AND b.side = 'R' AND b.idx = right_seq""",
}
_POINTS = {"sim_at_quarter_length": "s // 4", "sim_at_half_length": "s // 2", "sim_at_full_length": "s", "sim_at_double_length": "s * 2"}

ORACLE = {
    "c1_distance_cells": sql(f'SELECT "left", "right", left_seq, right_seq, {q6("dist")} FROM cells', "fx_chunk", **_CELLS),
    "c2_recentred_cells": sql("""SELECT l."left", l."right", l.seq AS left_seq, r.seq AS right_seq,
        round(1 - list_cosine_similarity(l.vec, r.vec) + 1e-10, 5) AS dist FROM centred l JOIN centred r
        ON l."left" = r."left" AND l."right" = r."right" AND l.side = 'L' AND r.side = 'R'""", "fx_chunk", pairs=PAIRS, long=LONG,
        means="SELECT htid, pos, avg(x) AS m FROM long GROUP BY ALL",
        center="""SELECT "left", "right", a.pos, (a.m + b.m) / 2 AS c FROM pairs JOIN means a ON a.htid = "left" JOIN means b ON b.htid = "right" AND a.pos = b.pos""",
        centred=CENTRED),
    "c3_median_centred": sql("""SELECT l."left", l."right", l.seq AS left_seq, r.seq AS right_seq,
        round(list_dot_product(l.vec, r.vec) + 1e-10, 5) AS sim FROM centred l JOIN centred r
        ON l."left" = r."left" AND l."right" = r."right" AND l.side = 'L' AND r.side = 'R'""", "fx_chunk", pairs=PAIRS, long=LONG,
        center="""SELECT "left", "right", pos, quantile_cont(x, 0.5) AS c FROM pairs JOIN long ON htid = "left" OR htid = "right" GROUP BY ALL""",
        centred=CENTRED),
    "c4_similarity_cells": sql(f'SELECT "left", "right", left_seq, right_seq, {q6("1 - dist", "sim")} FROM cells', "fx_chunk", **_CELLS),
    "c5_unrolled_matrix": sql("""SELECT p."left", p."right", CAST(i AS INTEGER) AS i,
        coalesce(round((1 - dist)::FLOAT::DOUBLE + 1e-9, 4), round(0.0::DOUBLE + 1e-9, 4)) AS x
        FROM (SELECT pairs.*, unnest(range(0, 144)) AS i FROM pairs) p LEFT JOIN cells c
        ON c."left" = p."left" AND c."right" = p."right" AND (left_seq - 1) * 12 + right_seq - 1 = i""", "fx_chunk", **_CELLS),
    "c6_page_jaccard": sql(f'SELECT "left", "right", left_seq, right_seq, {q6("sim")} FROM jcells', "fx_token", "fx_pairs", **JACC),
    # One diagonal of the matrix per step; a step keeps the diagonal before it, and a row that outlives empty diagonals.
    "c7_score_matrix": sql(f'''SELECT l AS "left", r AS "right", i AS left_seq, j AS right_seq, {q6("score")} FROM diagonals WHERE i + j = step''',
        "fx_token", "fx_pairs", **JACC,
        strong="""SELECT "left" AS l, "right" AS r, left_seq::BIGINT AS i, right_seq::BIGINT AS j, sim FROM jcells WHERE sim > 0.2""",
        diagonals="""SELECT -1::BIGINT AS step, '' AS l, '' AS r, -9::BIGINT AS i, -9::BIGINT AS j, 0.0::DOUBLE AS score
          UNION ALL SELECT step + 1, l, r, i, j, score FROM (
            SELECT w.step, s.l, s.r, s.i, s.j, s.sim - 0.2 + coalesce(max(w2.score), 0) AS score
            FROM (SELECT step FROM diagonals WHERE i = -9) w JOIN strong s ON s.i + s.j = w.step + 1
            LEFT JOIN diagonals w2 ON w2.l = s.l AND w2.r = s.r AND w2.i IN (s.i, s.i - 1) AND w2.j IN (s.j, s.j - 1)
            GROUP BY w.step, s.l, s.r, s.i, s.j, s.sim
            UNION ALL SELECT step, l, r, i, j, score FROM diagonals WHERE i + j = step
            UNION ALL SELECT step, l, r, i, j, score FROM diagonals WHERE i = -9 AND step < (SELECT max(i + j) FROM strong))"""),
    "c5_unrolled_jaccard": sql("""SELECT p."left", p."right", CAST(i AS INTEGER) AS i,
        coalesce(round(sim::FLOAT::DOUBLE + 1e-9, 4), round(0.0::DOUBLE + 1e-9, 4)) AS x
        FROM (SELECT DISTINCT fx_pairs.*, unnest(range(0, 36)) AS i FROM fx_pairs) p LEFT JOIN jcells c
        ON c."left" = p."left" AND c."right" = p."right" AND left_seq < 6 AND right_seq < 6 AND left_seq * 6 + right_seq = i""", "fx_token", "fx_pairs", **JACC),
    "c14_two_kinds": sql(f"""SELECT s."left", s."right", l_size, r_size, min_size, {", ".join(q6(c) for c in C11_VALUES)}, q.* EXCLUDE ("left", "right"), h.* EXCLUDE ("left", "right")
        FROM ({_stats_sql([0.7, 0.8])}) s
        JOIN (SELECT "left", "right", {_QUANTILES.format(p="")} FROM margins GROUP BY ALL) q ON q."left" = s."left" AND q."right" = s."right"
        JOIN (SELECT "left", "right", {_QUANTILES.format(p="half_")} FROM hmargins GROUP BY ALL) h ON h."left" = s."left" AND h."right" = s."right\"""",
        "fx_chunk", **_STATS, hcells=CELLS.replace("l.vec::DOUBLE[], r.vec::DOUBLE[]", "l.vec[1:32]::DOUBLE[], r.vec[1:32]::DOUBLE[]"),
        hmargins=MARGINS.replace("FROM cells", "FROM hcells")),
    "x2_cells_where": sql(f'SELECT "left", "right", left_seq, right_seq, {q6("dist")} FROM cells WHERE dist < 0.8 OR dist > 1.2', "fx_chunk", **_CELLS),
    "c11_matrix_stats": sql(f"""SELECT "left", "right", l_size, r_size, min_size, {", ".join(q6(c) for c in C11_VALUES)}
        FROM ({_stats_sql([0.7, 0.8])})""", "fx_chunk", **_STATS),
    "c12_margin_quantiles": sql(f"""SELECT "left", "right", {", ".join(q6(f"quantile_cont(d, {i / 10}) FILTER (side = '{s}')", f"{s}_quantile_{i}") for s in "lr" for i in range(10))}
        FROM margins GROUP BY ALL""", "fx_chunk", **_CELLS, margins=MARGINS),
    "c13_page_counts": sql(f"""SELECT target AS "left", candidate AS "right", l.page_count AS left_page_count, r.page_count AS right_page_count,
        l.page_count - r.page_count AS page_diff, {q6('(l.page_count - r.page_count) / l.page_count', 'page_prop_diff')}
        FROM fx_rel JOIN fx_meta l ON l.htid = target JOIN fx_meta r ON r.htid = candidate""", "fx_rel", "fx_meta"),
    "c17_mean_vector_features": sql(f"""SELECT "left", "right", form, CAST(pos AS INTEGER) AS pos, {q6('x')} FROM (
        SELECT p.*, 'mean_diff' AS form, a.pos - 1 AS pos, (a.m + b.m) / 2 AS x FROM pairs p JOIN means a ON a.htid = "left" JOIN means b ON b.htid = "right" AND a.pos = b.pos
        UNION ALL SELECT p.*, 'mean_diff', a.pos + 63, a.m - b.m FROM pairs p JOIN means a ON a.htid = "left" JOIN means b ON b.htid = "right" AND a.pos = b.pos
        UNION ALL SELECT p.*, 'concat', a.pos - 1, a.m FROM pairs p JOIN means a ON a.htid = "left"
        UNION ALL SELECT p.*, 'concat', a.pos + 63, a.m FROM pairs p JOIN means a ON a.htid = "right")""", "fx_chunk", pairs=PAIRS, long=LONG,
        means="SELECT htid, pos, avg(x) AS m FROM long GROUP BY ALL"),
    "c18_derived_stats": sql(f"""SELECT "left", "right", {q6('l_prop_dist_0800')}, {q6('r_prop_dist_0800')},
        {q6('l_size * 2 / l_size', 'l_sw_0005_prop')}, {q6('l_size * 2 / r_size', 'r_sw_0005_prop')},
        {", ".join(q6(f"ln({c} + 1e-7)", c + "_log") for c in ("mean_dist", "l_mean_min_dist", "r_mean_min_dist", "l_trunc_dist", "r_trunc_dist"))},
        {q6('l_size / r_size', 'prop_size')} FROM ({_stats_sql([0.8])})""", "fx_chunk", **_STATS),
    "c19_title_distances": sql(f"""SELECT target AS "left", match AS "right", {q6('1 - cos', 'title_distance')} FROM {ring('author', 5)}
        JOIN fx_meta a ON a.htid = target JOIN fx_meta b ON b.htid = match JOIN td ON t1 = a.title AND t2 = b.title""", "fx_meta", **fx.title_views()),
    "f13_set_jaccard": sql(f"""SELECT l_orderkey, {q6("(len(list_intersect(m, m2)) / greatest(len(list_distinct(list_concat(m, m2))), 1))", "jaccard")} FROM
        (SELECT l_orderkey, list(DISTINCT part % 20) AS m FROM fx_lines GROUP BY 1) JOIN
        (SELECT l_orderkey - 1 AS l_orderkey, list(DISTINCT part % 20) AS m2 FROM fx_lines GROUP BY 1) USING (l_orderkey)""", "fx_lines"),
    "j29_runs_with_words": sql("""SELECT "left", "right", left_seq, right_seq, a.words AS left_words, b.words AS right_words FROM jcells
        JOIN pages a ON a.htid = "left" AND a.idx = left_seq JOIN pages b ON b.htid = "right" AND b.idx = right_seq WHERE sim > 0.2""",
        "fx_token", "fx_pairs", **JACC),
    "l9_four_points": sql(f"""SELECT p."left", p."right", {", ".join(f"round(coalesce(max(sim) FILTER (rn = {at}), 0) + 1e-10, 6) AS {n}" for n, at in _POINTS.items())}
        FROM (SELECT x.*, least((SELECT count(*) FROM pages WHERE htid = "left"), (SELECT count(*) FROM pages WHERE htid = "right")) AS s FROM fx_pairs x) p
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY sim DESC, left_seq, right_seq) - 1 AS rn FROM jcells) c
        ON c."left" = p."left" AND c."right" = p."right" GROUP BY p."left", p."right\"""", "fx_token", "fx_pairs", **JACC),
}
