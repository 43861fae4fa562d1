"""Joins (J) other than nearest-neighbour joins."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.filters import stats
from catalog.fixtures import q6, q6s, r6, r6s, sql
from textkin.operators import candidates, compare, crosswalk, evaluate, graph, knn, relations, vectorize
from textkin.operators.ranks import sample_rows
from textkin.schemas import LABELS
from textkin.sources import sinks

LABEL_COLS = LABELS


def rel(spark, sf):
    return fx.predictions(spark, sf)


def clusters(spark, sf):
    """Manifestations: equal author and title; works: equal title."""
    return fx.meta(spark, sf).select(
        "htid", F.concat_ws("/", "author", "title").alias("man_id"), F.col("title").alias("work_id"))


CLUSTERS = "SELECT htid, author || '/' || title AS man_id, title AS work_id FROM fx_meta"


def clean(spark, sf):
    return relations.reciprocal_means(relations.flip_judgments(rel(spark, sf)))


_FLIP = ", ".join(
    f"CASE WHEN target > candidate THEN {dict(p_partof='p_contains', p_contains='p_partof').get(c, c)} ELSE {c} END AS {c}"
    for c in LABELS)
CLEAN = f"""SELECT target, candidate, {", ".join(f"avg({c}) AS {c}" for c in LABELS)}, count(*) AS count FROM (
  SELECT least(target, candidate) AS target, greatest(target, candidate) AS candidate, {_FLIP} FROM fx_rel)
  GROUP BY target, candidate HAVING count(*) > 1"""


def shops(spark, sf):
    """Metadata of the vector books: one supplier per book."""
    return fx.table(spark, sf, "supplier").select(
        F.concat(F.lit("b."), "s_suppkey").alias("htid"), F.col("s_name").alias("title"),
        F.concat(F.lit("nation "), F.col("s_nationkey") % 6).alias("author"))


SHOPS = """SELECT 'b.' || s_suppkey AS htid, s_name AS title, 'nation ' || (s_nationkey % 6) AS author FROM supplier"""


def truth(spark, sf):
    """Each book and the book numbered like its chunk's label."""
    return fx.chunk_vectors(spark, sf).groupBy(
        F.col("htid").alias("left"), F.concat(F.lit("b."), "label").alias("right")).agg(
        F.when(F.max("seq") > 8, "SWSM").when(F.max("seq") > 5, "SWDE").otherwise("RANDDIFF").alias("judgment"))


TRUTH = """SELECT htid AS "left", 'b.' || label AS "right", CASE WHEN max(seq) > 8 THEN 'SWSM'
  WHEN max(seq) > 5 THEN 'SWDE' ELSE 'RANDDIFF' END AS judgment FROM fx_chunk GROUP BY 1, 2"""


def next_books(spark, sf):
    """Each vector book with the one numbered after it."""
    b = fx.chunk_vectors(spark, sf).select("htid").distinct()
    n = F.substring_index("htid", ".", -1).cast("long")
    return b.select(F.col("htid").alias("left"), F.concat(F.lit("b."), n + 1).alias("right")).join(
        b.withColumnRenamed("htid", "right"), "right", "left_semi")


NEXT = """SELECT DISTINCT a.htid AS "left", b.htid AS "right" FROM fx_chunk a JOIN fx_chunk b
  ON b.vec_id // 10 = a.vec_id // 10 + 1"""


def j1_join_metadata(spark, sf):
    return relations.with_metadata(rel(spark, sf).select("target", "candidate"), fx.meta(spark, sf), ["title", "author"])


def j2_both_metadata(spark, sf):
    return relations.both_metadata(rel(spark, sf).select("target", "candidate"), fx.meta(spark, sf), ["title", "oclc_num"])


def j3_relabel_pairs(spark, sf):
    return graph.relabel_pairs(rel(spark, sf).select("target", "candidate"), clusters(spark, sf), "work_id").groupBy(
        "target", "candidate").agg(F.count("*").alias("n"))


def j4_same_cluster_edges(spark, sf):
    return graph.same_cluster_edges(rel(spark, sf), clusters(spark, sf), "work_id").select(
        "cluster", "target", "candidate", r6(F.col("p_swsm") + F.col("p_swde"), "sw"))


def j5_merge_labels(spark, sf):
    c = clusters(spark, sf)
    new = c.select("work_id", F.col("man_id").alias("htid")).distinct()
    return graph.merge_labels(c.select("htid", "man_id"), new, "work_id", "man_id", "man_id_pass1")


def _work_predictions(spark, sf):
    return graph.clustered_predictions(clean(spark, sf), clusters(spark, sf), "work_id")


def j6_internal_coherence(spark, sf):
    st = graph.cluster_stats(clusters(spark, sf), fx.meta(spark, sf), "work_id")
    return graph.internal_coherence(_work_predictions(spark, sf), st, "work_id", 20).select(
        "target", "label_count", "count", *r6s("p_swsm", "p_grsim"))


def j7_members_meta_stats(spark, sf):
    c, m = clusters(spark, sf), fx.meta(spark, sf)
    st = graph.ordinary_works(graph.cluster_stats(c, m, "work_id"))
    return c.join(m.select("htid", "access"), "htid").join(st.select("work_id", "label_count"), "work_id").select(
        "work_id", "man_id", "htid", "access", "label_count")


def j8_chunks_left_meta(spark, sf):
    return fx.chunk_vectors(spark, sf).select("htid", "seq").join(shops(spark, sf), "htid", "left")


def _results(spark, sf):
    """Matches in shape (left, right, mean): label twins of consecutive chunks."""
    c = fx.chunk_vectors(spark, sf)
    return c.groupBy(F.col("htid").alias("left"), F.concat(F.lit("b."), F.pmod(F.col("label") * F.col("seq"), F.lit(12))).alias("right")).agg(
        F.round(F.avg(F.col("seq") / 10.0), 9).alias("mean"))


RESULTS = """SELECT htid AS "left", 'b.' || ((label * seq) % 12) AS "right", round(avg(seq / 10.0::DOUBLE), 9) AS mean
  FROM fx_chunk GROUP BY 1, 2"""


def j9_truth_left_results(spark, sf):
    return evaluate.truth_with_results(evaluate.usable_truth(truth(spark, sf)), _results(spark, sf)).select(
        "left", "right", "judgment", r6("mean"))


def j10_outer_compare(spark, sf):
    a = _results(spark, sf).withColumnRenamed("mean", "dist")
    b = truth(spark, sf).select("left", "right", F.length("judgment").cast("double").alias("dist"))
    return evaluate.outer_compare(a, b, ["left", "right"]).select("left", "right", *r6s("exact", "approx"))


def j11_natural_join(spark, sf):
    return _results(spark, sf).join(truth(spark, sf), ["left", "right"]).select("left", "right", "judgment", r6("mean"))


def j12_semi_join(spark, sf):
    wanted = crosswalk.common_values(fx.meta(spark, sf).where("us_gov_doc_flag = 1"), "author",
                                     fx.meta(spark, sf).where("bib_fmt = 'SE'"), "author")
    return crosswalk.reduce_to(fx.meta(spark, sf), wanted, "author").select("htid", "author")


def j13_anti_join(spark, sf):
    done = rel(spark, sf).select(F.col("target").alias("htid"))
    everyone = fx.table(spark, sf, "lineitem").select(fx.volume_id("l_partkey").alias("htid")).unionByName(
        fx.docs(spark, sf).select("htid")).distinct()
    return sinks.remaining(everyone, done)


def j14_range_lookup(spark, sf):
    """Chunk number inside its volume for every id of the contiguous ranges."""
    return candidates.range_ids(candidates.volume_ranges(fx.chunk_vectors(spark, sf)))


def j15_id_lookup(spark, sf):
    r = candidates.volume_ranges(fx.chunk_vectors(spark, sf))
    return fx.chunk_vectors(spark, sf).select("htid", "seq").join(r, "htid").select(
        "htid", "seq", (F.col("min") + F.col("seq") - 1).alias("id"))


def j16_paired_distance(spark, sf):
    c = vectorize.unit_vectors(fx.chunk_vectors(spark, sf).select("htid", "seq", "vec"))
    return compare.paired_similarities(c, c, next_books(spark, sf)).select(
        "left", "right", "left_seq", "right_seq", F.round(F.col("sim") + 1e-10, 5).alias("sim"))


def j17_random_pairs(spark, sf):
    c = fx.chunk_vectors(spark, sf)
    a = knn.random_pairs(c, 100)
    b = knn.random_pairs(c, 100, "label")
    return a.unionByName(b).select("target", "target_seq", "match", "match_seq", "relation", r6("sim"))


def j22_same_author(spark, sf):
    return candidates.same_author_candidates(fx.meta(spark, sf), max_results=20)


def j23_author_truth(spark, sf):
    return evaluate.author_truth_sizes(truth(spark, sf), shops(spark, sf))


def j23_author_pairs(spark, sf):
    """The pairs themselves, for the targets of the truth."""
    t = truth(spark, sf)
    return evaluate.author_truth_pairs(t, shops(spark, sf), t.select(F.col("left").alias("htid")))


def j24_rating_lists(spark, sf):
    m = fx.meta(spark, sf)
    t = sample_rows(m.select("htid"), 20, ["htid"])
    return candidates.rating_lists(m, t)


def _keyed(spark, sf):
    v = crosswalk.volume_keys(fx.meta(spark, sf))
    b = crosswalk.books_with_author(fx.books(spark, sf), fx.meta(spark, sf).select(F.col("author").alias("author_id")).distinct())
    b = crosswalk.with_code(b, crosswalk.clean_author(F.col("author_id")), crosswalk.simple_title(F.col("title")))
    return b, v


def j25_code_alignment(spark, sf):
    b, v = crosswalk.align(*_keyed(spark, sf))
    return b.groupBy("code").agg(F.count("*").alias("books")).join(v.groupBy("code").agg(F.count("*").alias("volumes")), "code")


def _links(spark, sf):
    return fx.edges(spark, sf).select(F.col("a").alias("book_id"), F.col("b").alias("similar_id"))


def j26_similar_codes(spark, sf):
    b, v = crosswalk.align(*_keyed(spark, sf))
    return crosswalk.similar_summary(b, v, _links(spark, sf))


def j27_similar_pairs(spark, sf):
    b, v = crosswalk.align(*_keyed(spark, sf))
    return crosswalk.similar_pairs(b, v, _links(spark, sf), fx.meta(spark, sf).where("key % 20 = 0"))


def j28_zip_vectors(spark, sf):
    c = fx.chunk_vectors(spark, sf)
    a, b = c.where("label <> 3"), c.where("label <> 7")
    zipped = vectorize.zip_vectors(a, b).select("htid", "seq", F.lit("both").alias("state"), F.posexplode("vec").alias("pos", "x"))
    missing = vectorize.zip_mismatches(a, b).select("htid", "seq", F.col("missing_from").alias("state"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("float").alias("x"))
    return zipped.unionByName(missing).select("htid", "seq", "state", "pos", F.round(F.col("x").cast("double") + 1e-10, 6).alias("x"))


def j30_first_author(spark, sf):
    b, _ = _keyed(spark, sf)
    return b.select("book_id", "title", "author_id")


def j31_top_with_metadata(spark, sf):
    return relations.with_metadata(relations.top_ids(rel(spark, sf), "target", 300), fx.meta(spark, sf), ["title"])


def j32_expand_volumes(spark, sf):
    ids = shops(spark, sf).select("htid")
    return fx.chunk_vectors(spark, sf).join(ids, "htid", "left_semi").select("htid", "seq", "label")


QUERIES = {f.__name__: f for f in (
    j1_join_metadata, j2_both_metadata, j3_relabel_pairs, j4_same_cluster_edges, j5_merge_labels,
    j6_internal_coherence, j7_members_meta_stats, j8_chunks_left_meta, j9_truth_left_results, j10_outer_compare,
    j11_natural_join, j12_semi_join, j13_anti_join, j14_range_lookup, j15_id_lookup, j16_paired_distance,
    j17_random_pairs, j22_same_author, j23_author_truth, j23_author_pairs, j24_rating_lists, j25_code_alignment, j26_similar_codes,
    j27_similar_pairs, j28_zip_vectors, j30_first_author, j31_top_with_metadata, j32_expand_volumes)}

STATS_BY_WORK = """SELECT work_id, count(*) AS label_count, count(*) FILTER (us_gov_doc_flag = 1) AS gov_count,
  count(*) FILTER (bib_fmt = 'SE') AS serial_count, count(*) FILTER (us_gov_doc_flag = 1) / count(*) AS gov_prop,
  count(*) FILTER (bib_fmt = 'SE') / count(*) AS serial_prop
  FROM clusters JOIN fx_meta USING (htid) GROUP BY work_id"""
# Works of one canonical pair; partof and contains trade places with the ends.
WORK_PAIRS = f"""SELECT least(t, c) AS target, greatest(t, c) AS candidate,
  {", ".join(f"sum((CASE WHEN t > c THEN {dict(p_partof='p_contains', p_contains='p_partof').get(x, x)} ELSE {x} END) * count) / sum(count) AS {x}" for x in LABELS)},
  CAST(sum(count) AS BIGINT) AS count
  FROM (SELECT a.work_id AS t, b.work_id AS c, clean.* EXCLUDE (target, candidate) FROM clean
        JOIN clusters a ON a.htid = target JOIN clusters b ON b.htid = candidate) GROUP BY 1, 2"""
RANGES = """SELECT htid, CAST(sum(n) OVER o AS BIGINT) - n AS min, n FROM (SELECT htid, count(*) AS n, md5('1234|' || htid) AS k
  FROM fx_chunk GROUP BY htid) WINDOW o AS (ORDER BY k, htid)"""
_CODE = r"""regexp_replace(lower(CASE WHEN t LIKE '%: a tale' THEN substr(t, 1, len(t) - 8) ELSE t END), '[^\p{L}\p{N}_]', '', 'g')"""
KEYED = {
    "bk": f"SELECT book_id, author_id || '__' || {_CODE.replace('t LIKE', 'title LIKE').replace('substr(t, 1, len(t)', 'substr(title, 1, len(title)').replace('ELSE t END', 'ELSE title END')} AS code FROM fx_books",
    "vo": f"SELECT htid, author || '__' || {_CODE.replace('t LIKE', 'title LIKE').replace('substr(t, 1, len(t)', 'substr(title, 1, len(title)').replace('ELSE t END', 'ELSE title END')} AS code FROM fx_meta",
    "codes": """SELECT DISTINCT x.code, y.code AS similar_code FROM fx_edges JOIN bk x ON x.book_id = a JOIN bk y ON y.book_id = b
      WHERE x.code IN (SELECT code FROM vo) AND y.code IN (SELECT code FROM vo)""",
}
_RING = """SELECT htid, author, row_number() OVER (PARTITION BY author ORDER BY md5('1234|' || htid), htid) - 1 AS pos,
  count(*) OVER (PARTITION BY author) AS size FROM fx_meta"""
_RAND = """SELECT htid, seq, vec, label, md5('{s}|' || htid || '|' || seq) AS k FROM fx_chunk {w}"""


def _random_sql(where, relation):
    return f"""SELECT l.htid AS target, l.seq AS target_seq, r.htid AS match, r.seq AS match_seq, '{relation}' AS relation,
      {q6("list_cosine_similarity(l.vec::DOUBLE[], r.vec::DOUBLE[])", "sim")} FROM
      (SELECT *, row_number() OVER (ORDER BY k, htid, seq) AS p FROM ({_RAND.format(s=1234, w=where)}) ORDER BY k, htid, seq LIMIT 100) l JOIN
      (SELECT *, row_number() OVER (ORDER BY k, htid, seq) AS p FROM ({_RAND.format(s=1235, w=where)}) ORDER BY k, htid, seq LIMIT 100) r USING (p)"""


_LABEL_DRAW = "WHERE label = (SELECT label FROM (SELECT DISTINCT label FROM fx_chunk) ORDER BY md5('1234|' || label), label LIMIT 1)"

ORACLE = {
    "j1_join_metadata": sql("SELECT target, candidate, title, author FROM fx_rel JOIN fx_meta ON htid = target", "fx_rel", "fx_meta"),
    "j2_both_metadata": sql("""SELECT target, candidate, a.title AS target_title, a.oclc_num AS target_oclc_num,
        b.title AS candidate_title, b.oclc_num AS candidate_oclc_num
        FROM fx_rel JOIN fx_meta a ON a.htid = target JOIN fx_meta b ON b.htid = candidate""", "fx_rel", "fx_meta"),
    "j3_relabel_pairs": sql("""SELECT a.work_id AS target, b.work_id AS candidate, count(*) AS n FROM fx_rel
        JOIN clusters a ON a.htid = target JOIN clusters b ON b.htid = candidate GROUP BY 1, 2""", "fx_rel", "fx_meta", clusters=CLUSTERS),
    "j4_same_cluster_edges": sql(f"""SELECT a.work_id AS cluster, target, candidate, {q6('p_swsm + p_swde', 'sw')} FROM fx_rel
        JOIN clusters a ON a.htid = target JOIN clusters b ON b.htid = candidate AND a.work_id = b.work_id""",
        "fx_rel", "fx_meta", clusters=CLUSTERS),
    "j5_merge_labels": sql("SELECT htid, man_id AS man_id_pass1, work_id FROM clusters", "fx_meta", clusters=CLUSTERS),
    "j6_internal_coherence": sql(f"""SELECT target, label_count, count, {q6s('p_swsm', 'p_grsim')} FROM wp
        JOIN st ON work_id = target WHERE target = candidate AND label_count >= 20""", "fx_rel", "fx_meta",
        clusters=CLUSTERS, clean=CLEAN, wp=WORK_PAIRS, st=STATS_BY_WORK),
    "j7_members_meta_stats": sql("""SELECT work_id, man_id, htid, access, label_count FROM clusters JOIN fx_meta USING (htid)
        JOIN st USING (work_id) WHERE gov_prop < .5 AND serial_prop < .5 AND label_count > 1""", "fx_meta", clusters=CLUSTERS, st=STATS_BY_WORK),
    "j8_chunks_left_meta": sql("SELECT htid, seq, title, author FROM fx_chunk LEFT JOIN shops USING (htid)", "fx_chunk", shops=SHOPS),
    "j9_truth_left_results": sql(f"""SELECT "left", "right", judgment, {q6('mean')} FROM truth LEFT JOIN res USING ("left", "right")
        WHERE judgment NOT IN ('RANDDIFF', 'AUTHOR')""", "fx_chunk", truth=TRUTH, res=RESULTS),
    "j10_outer_compare": sql(f"""SELECT "left", "right", {q6('coalesce(mean, 1.2::DOUBLE)', 'exact')},
        {q6('coalesce(CAST(len(judgment) AS DOUBLE), 0.4::DOUBLE)', 'approx')}
        FROM res FULL JOIN truth USING ("left", "right")""", "fx_chunk", truth=TRUTH, res=RESULTS),
    "j11_natural_join": sql(f"""SELECT "left", "right", judgment, {q6('mean')} FROM truth JOIN res USING ("left", "right")""", "fx_chunk", truth=TRUTH, res=RESULTS),
    "j12_semi_join": sql("""SELECT htid, author FROM fx_meta WHERE author IN (SELECT author FROM fx_meta WHERE us_gov_doc_flag = 1
        INTERSECT SELECT author FROM fx_meta WHERE bib_fmt = 'SE')""", "fx_meta"),
    "j13_anti_join": sql(f"""SELECT DISTINCT htid FROM (SELECT {fx.sql_id('l_partkey')} AS htid FROM lineitem
        UNION ALL SELECT 'd.' || doc_id FROM documents) WHERE htid NOT IN (SELECT target FROM fx_rel)""", "fx_rel"),
    "j14_range_lookup": sql("""SELECT id, htid, id - min + 1 AS seq FROM ranges r, LATERAL (SELECT unnest(range(r.min, r.min + r.n)) AS id)""",
        "fx_chunk", ranges=RANGES),
    "j15_id_lookup": sql("SELECT htid, seq, min + seq - 1 AS id FROM fx_chunk JOIN ranges USING (htid)", "fx_chunk", ranges=RANGES),
    "j16_paired_distance": sql("""SELECT "left", "right", l.seq AS left_seq, r.seq AS right_seq,
        round(list_cosine_similarity(l.vec::DOUBLE[], r.vec::DOUBLE[]) + 1e-10, 5) AS sim
        FROM pairs JOIN fx_chunk l ON l.htid = "left" JOIN fx_chunk r ON r.htid = "right\"""", "fx_chunk",
        pairs=NEXT.replace("a.vec_id // 10", "CAST(substr(a.htid, 3) AS BIGINT)").replace("b.vec_id // 10", "CAST(substr(b.htid, 3) AS BIGINT)")),
    "j17_random_pairs": sql(_random_sql("", "random") + " UNION ALL " + _random_sql(_LABEL_DRAW, "label"), "fx_chunk"),
    "j22_same_author": sql("""SELECT m.htid AS match, t.htid AS target, 'author' AS note FROM ring t,
        LATERAL (SELECT unnest(range(1, least(20, t.size - 1) + 1)) AS step) JOIN ring m
        ON m.author = t.author AND m.pos = (t.pos + step) % t.size""", "fx_meta", ring=_RING),
    "j23_author_truth": sql("""SELECT l.htid AS "left", (SELECT count(*) FROM shops r WHERE r.author = l.author AND r.htid <> l.htid
          AND NOT EXISTS (SELECT 1 FROM truth g WHERE g."left" = l.htid AND g."right" = r.htid)) AS author_truth
        FROM shops l WHERE l.htid IN (SELECT "left" FROM truth)""", "fx_chunk", shops=SHOPS, truth=TRUTH),
    "j23_author_pairs": sql("""SELECT l.htid AS "left", r.htid AS "right", 'author' AS judgment FROM shops l JOIN shops r ON r.author = l.author AND r.htid <> l.htid
        WHERE l.htid IN (SELECT "left" FROM truth) AND NOT EXISTS (SELECT 1 FROM truth g WHERE g."left" = l.htid AND g."right" = r.htid)""",
        "fx_chunk", shops=SHOPS, truth=TRUTH),
    "j24_rating_lists": sql("""SELECT target, match, min(rule) AS rule FROM (SELECT * FROM init UNION ALL SELECT * FROM auth UNION ALL SELECT * FROM rnd)
        GROUP BY target, match""", "fx_meta",
        t="SELECT htid FROM fx_meta ORDER BY md5('1234|' || htid), htid LIMIT 20",
        k="""SELECT htid, 'oclc' AS rule, oclc_num AS v FROM fx_meta UNION ALL SELECT htid, 'lccn', lccn FROM fx_meta UNION ALL SELECT htid, 'isbn', isbn FROM fx_meta
          UNION ALL SELECT htid, 'title', title FROM fx_meta UNION ALL SELECT htid, 'short_title', substr(title, 1, 30) FROM fx_meta""",
        init="""SELECT a.htid AS target, b.htid AS match, min(a.rule) AS rule FROM k a JOIN k b ON a.rule = b.rule AND a.v = b.v AND a.htid <> b.htid
          WHERE a.htid IN (SELECT htid FROM t) GROUP BY 1, 2""",
        auth="""SELECT x.htid AS target, y.htid AS match, 'author' AS rule FROM fx_meta x JOIN fx_meta y ON x.author = y.author AND x.htid <> y.htid
          WHERE x.htid IN (SELECT htid FROM t) AND NOT EXISTS (SELECT 1 FROM init i WHERE i.target = x.htid AND i.match = y.htid)
          QUALIFY row_number() OVER (PARTITION BY x.htid ORDER BY md5('1234|' || y.htid), y.htid) <= 5""",
        rnd="""SELECT d.htid AS target, m.htid AS match, 'random' AS rule FROM (SELECT htid, unnest([0, 1, 2, 3]) AS i FROM t) d JOIN
          (SELECT htid, row_number() OVER (ORDER BY md5('1234|' || htid), htid) - 1 AS pos FROM fx_meta) m
          ON m.pos = (CAST('0x' || substr(md5('1234|' || d.htid), 1, 14) AS BIGINT) + d.i) % (SELECT count(*) FROM fx_meta) WHERE m.htid <> d.htid
          QUALIFY row_number() OVER (PARTITION BY d.htid ORDER BY d.i) <= 3"""),
    "j25_code_alignment": sql("""SELECT code, (SELECT count(*) FROM bk WHERE bk.code = v.code) AS books, count(*) AS volumes FROM vo v
        WHERE code IN (SELECT code FROM bk) GROUP BY code""", "fx_meta", "fx_books", bk=KEYED["bk"], vo=KEYED["vo"]),
    "j26_similar_codes": sql("""SELECT code, (SELECT count(*) FROM bk WHERE bk.code = c.code) AS books,
        (SELECT count(*) FROM vo WHERE vo.code = c.code) AS volumes, count(*) AS similar_codes,
        CAST(sum((SELECT count(*) FROM vo WHERE vo.code = c.similar_code)) AS BIGINT) AS similar_volumes
        FROM codes c GROUP BY code""", "fx_meta", "fx_books", "fx_edges", **KEYED),
    "j27_similar_pairs": sql("""SELECT DISTINCT l.htid AS "left", r.htid AS "right", 'GRSIM' AS relationship FROM vo l JOIN codes USING (code)
        JOIN vo r ON r.code = similar_code WHERE l.htid <> r.htid AND CAST(split_part(l.htid, '.', 2) AS BIGINT) % 20 = 0""", "fx_meta", "fx_books", "fx_edges", **KEYED),
    "j28_zip_vectors": sql("""SELECT htid, seq, 'both' AS state, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v)::DOUBLE + 1e-10, 6) AS x
        FROM (SELECT htid, seq, list_concat(vec, vec) AS v FROM fx_chunk WHERE label NOT IN (3, 7))
        UNION ALL SELECT htid, seq, CASE label WHEN 3 THEN 'left' ELSE 'right' END, NULL, NULL FROM fx_chunk WHERE label IN (3, 7)""", "fx_chunk"),
    "j30_first_author": sql("SELECT book_id, title, author_id FROM fx_books", "fx_books"),
    "j31_top_with_metadata": sql("""SELECT target, count, title FROM (SELECT target, count(*) AS count FROM fx_rel GROUP BY target
        ORDER BY count DESC, target LIMIT 300) JOIN fx_meta ON htid = target""", "fx_rel", "fx_meta"),
    "j32_expand_volumes": sql("SELECT htid, seq, label FROM fx_chunk WHERE htid IN (SELECT htid FROM shops)", "fx_chunk", shops=SHOPS),
}
