"""Projections, filters and predicates (P), over the whole input views."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import q6, q6s, r6, r6s, sql
from textkin.functions import ids, labels, text
from textkin.functions import vectors as vx
from textkin.operators import candidates, relations, vectorize
from textkin.schemas import JUDGMENTS, LABELS, RELATEDNESS_WEIGHTS
from textkin.sources import metadata


def stats(spark, sf):
    """Volume match statistics in miniature: supplier-part shares per order side."""
    e = fx.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.count("*").alias("count"), F.round(F.avg("l_discount"), 9).alias("mean"),
        F.round(F.avg(F.col("l_quantity") / 50), 9).alias("prop_target"), F.round(F.avg(F.col("l_tax") * 10), 9).alias("prop_match"))
    return e.withColumnRenamed("l_suppkey", "target").withColumnRenamed("l_partkey", "match")


STATS_SQL = """SELECT l_suppkey AS target, l_partkey AS match, count(*) AS count, round(avg(l_discount), 9) AS mean,
  round(avg(l_quantity / 50), 9) AS prop_target, round(avg(l_tax * 10), 9) AS prop_match FROM lineitem GROUP BY ALL"""
_STAT_COLS = ("mean", "prop_target", "prop_match")


def p1_predicate_filter(spark, sf):
    return metadata.get_where(fx.meta(spark, sf), "author = 'Brand#2' AND page_count > 200", ["htid", "title"])


def p2_volume_lookup(spark, sf):
    ids_ = fx.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(fx.volume_id("l_partkey").alias("htid"))
    return metadata.get_volumes(fx.meta(spark, sf), ids_, ["htid", "title", "author", "oclc_num"])


def p3_fields_offset(spark, sf):
    return metadata.get_fields(fx.meta(spark, sf), ["htid", "title", "isbn"], offset=100, limit=500)


def p4_meta_compare(spark, sf):
    pairs = fx.predictions(spark, sf).select(F.col("target").alias("left"), F.col("candidate").alias("right"))
    return metadata.compare(pairs, fx.meta(spark, sf))


def p5_candidate_filter(spark, sf):
    return candidates.filter_stats(stats(spark, sf), min_count=2, max_mean=0.06, min_prop_match=0.3).select(
        "target", "match", "count", *r6s(*_STAT_COLS))


def p6_strong_candidates(spark, sf):
    return candidates.strong_candidates(stats(spark, sf)).select("target", "match", "count", *r6s(*_STAT_COLS))


def p7_mean_filter(spark, sf):
    return candidates.filter_stats(stats(spark, sf), max_mean=0.03).select("target", "match", *r6s("mean"))


def p8_high_confidence(spark, sf):
    rel = fx.predictions(spark, sf)
    one = relations.high_confidence(rel, ["p_swsm"], 0.9).withColumn("rule", F.lit("swsm"))
    two = relations.high_confidence(rel, ["p_swsm", "p_swde"], 0.95).withColumn("rule", F.lit("swsm+swde"))
    return one.unionByName(two).select("rule", "target", "candidate", *r6s("p_swsm", "p_swde"))


def p9_flip_judgments(spark, sf):
    return relations.flip_judgments(fx.predictions(spark, sf).withColumn("guess", labels.guess())).select(
        "target", "candidate", "flipped", "guess", *r6s("p_partof", "p_contains"))


def p10_guess(spark, sf):
    return fx.predictions(spark, sf).select("target", "candidate", labels.guess().alias("guess"))


def p11_relatedness(spark, sf):
    return fx.predictions(spark, sf).select(
        "target", "candidate", r6(labels.relatedness(), "relatedness"))


def _holes(spark, sf):
    rel = fx.predictions(spark, sf)
    return rel.withColumns({
        "p_grsim": F.when(F.col("p_grsim") < 0.02, None).otherwise(F.col("p_grsim")),
        "p_swde": F.when(F.col("p_swde") < 0.02, float("nan")).otherwise(F.col("p_swde"))})


def p12_drop_incomplete(spark, sf):
    return labels.complete(_holes(spark, sf)).select("target", "candidate", *r6s("p_grsim", "p_swde"))


def p13_types(spark, sf):
    m = fx.meta(spark, sf)
    return m.select("htid", F.col("price").cast("float").cast("double").alias("price"),
                    F.col("oclc_num").try_cast("long").alias("oclc_num"),
                    F.col("rights_date_used").cast("string").alias("rights_date_used"))


def _broken(spark, sf):
    """Vectors with a NaN, a zero vector, or an infinite component, by label."""
    v = fx.chunk_vectors(spark, sf)
    return v.withColumn("vec", F.when(F.col("label") == 1, F.transform("vec", lambda x: (x * 0).cast("float")))
                        .when(F.col("label") == 2, F.transform("vec", lambda x, i: F.when(i == 3, float("nan")).otherwise(x).cast("float")))
                        .when(F.col("label") == 3, F.transform("vec", lambda x, i: F.when(i == 0, float("inf")).otherwise(x).cast("float")))
                        .otherwise(F.col("vec")))


def p14_drop_nan(spark, sf):
    return vectorize.drop_nan_vectors(_broken(spark, sf)).select("htid", "seq", "label")


def p15_usable_unit(spark, sf):
    v = vectorize.unit_vectors(_broken(spark, sf).withColumn("vec", F.transform("vec", lambda x: x * 3)), keep_type=False)
    return v.select("htid", "seq", r6(vx.norm(F.col("vec")), "norm"),
                    r6(F.element_at("vec", 1), "first"))


def _stream(spark, sf):
    """Line items as a chunk stream: volume = supplier of the line, in input order of (order, line)."""
    from textkin.operators.ranks import positions

    rows = fx.lines(spark, sf).select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("v."), F.col("part") % 40).alias("htid"), F.col("part").alias("seq"))
    return positions(rows, [], F.floor(F.col("l_orderkey") / 64), ["l_orderkey", "l_linenumber"])


def p16_single_stream(spark, sf):
    return vectorize.single_stream(_stream(spark, sf).select("pos", "htid", "seq")).select("htid", "seq", "pos")


def p17_dedupe_vectors(spark, sf):
    t = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("htid"), F.col("l_linenumber").alias("seq"), "l_partkey", "l_suppkey", "l_quantity")
    return vectorize.dedupe_vectors(t, ["l_partkey", "l_suppkey", "l_quantity"])


def _mtids(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("u-k."), "l_partkey").alias("h"), "l_linenumber", "l_suppkey", "l_returnflag").withColumn(
        "mtid", F.when(F.col("l_returnflag") == "R", ids.chunk_id(F.col("h"), F.col("l_linenumber"))).otherwise(
            ids.chunk_id(F.col("h"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_suppkey") + 7)))


def p18_split_chunk_id(spark, sf):
    m = _mtids(spark, sf).select("mtid").distinct()
    return m.withColumns(ids.split_chunk_id(F.col("mtid")))


def p19_format_chunk_id(spark, sf):
    return _mtids(spark, sf).groupBy("mtid").agg(F.count("*").alias("n"))


def p20_no_self(spark, sf):
    s = stats(spark, sf)
    return s.where("target <> match").groupBy("target").agg(F.count("*").alias("n"))


def _work_stats(spark, sf):
    return fx.meta(spark, sf).groupBy(F.col("title").alias("work_id")).agg(
        F.count("*").alias("label_count"), F.avg(F.col("us_gov_doc_flag").cast("double")).alias("gov_prop"),
        F.avg((F.col("bib_fmt") == "SE").cast("double")).alias("serial_prop"))


def p21_work_filter(spark, sf):
    from textkin.operators.graph import ordinary_works

    return ordinary_works(_work_stats(spark, sf)).select("work_id", "label_count", *r6s("gov_prop", "serial_prop"))


def p22_outlier_slice(spark, sf):
    from textkin.operators.compare import outlier_slice

    s = stats(spark, sf).withColumn("size", F.col("count") * 3)
    return outlier_slice(s, "mean", 0.2, "prop_target", 0.8, "size", 2).select("target", "match", *r6s("mean", "prop_target"))


def p23_text_predicates(spark, sf):
    p = fx.table(spark, sf, "part")
    g = fx.predictions(spark, sf).select("target", labels.guess().alias("guess"))
    a = g.where(F.col("guess").isin("SWSM", "SWDE")).groupBy(F.lit("isin").alias("rule")).agg(F.count("*").alias("n"))
    b = g.where(F.col("guess").rlike("^(SWDE|SWSM|WP)")).groupBy(F.lit("regex").alias("rule")).agg(F.count("*").alias("n"))
    c = p.where(F.col("p_name").startswith("red")).groupBy(F.lit("prefix").alias("rule")).agg(F.count("*").alias("n"))
    d = p.where(F.col("p_name").contains("widget")).groupBy(F.lit("contains").alias("rule")).agg(F.count("*").alias("n"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def p24_volume_number(spark, sf):
    m = fx.meta(spark, sf).withColumn("raw", F.when(F.col("us_gov_doc_flag") == 1, F.concat("description", F.lit("-2")))
                                      .otherwise(F.regexp_replace("description", "v", "Vol")))
    return m.withColumn("descint", text.volume_number(F.col("raw"))).where("descint IS NOT NULL").select("htid", "raw", "descint")


def p25_either_side(spark, sf):
    rel = fx.predictions(spark, sf).select("target", "candidate")
    return relations.either_side_of(rel, fx.meta(spark, sf)).groupBy("htid").agg(F.count("*").alias("n"))


def p26_rename(spark, sf):
    s = stats(spark, sf).withColumnsRenamed({"target": "left", "match": "right"})
    return s.select("left", "right", "count", *r6s("mean"))


QUERIES = {f.__name__: f for f in (
    p1_predicate_filter, p2_volume_lookup, p3_fields_offset, p4_meta_compare, p5_candidate_filter,
    p6_strong_candidates, p7_mean_filter, p8_high_confidence, p9_flip_judgments, p10_guess, p11_relatedness,
    p12_drop_incomplete, p13_types, p14_drop_nan, p15_usable_unit, p16_single_stream, p17_dedupe_vectors,
    p18_split_chunk_id, p19_format_chunk_id, p20_no_self, p21_work_filter, p22_outlier_slice,
    p23_text_predicates, p24_volume_number, p25_either_side, p26_rename)}

_GREATEST = "greatest(" + ", ".join(LABELS) + ")"
GUESS_SQL = "CASE " + " ".join(f"WHEN {c} = {_GREATEST} THEN '{j}'" for j, c in zip(JUDGMENTS, LABELS)) + " END"
RELATED_SQL = "((" + " + ".join(f"{c} * {RELATEDNESS_WEIGHTS[j]}::DOUBLE" for j, c in zip(JUDGMENTS, LABELS)) + ") / 5.0::DOUBLE)"
_STATS = {"stats": STATS_SQL}
_BROKEN = """SELECT htid, seq, label,
  CASE WHEN label = 1 THEN list_transform(vec, lambda x: (x * 0)::FLOAT)
       WHEN label = 2 THEN vec[1:3] || ['NaN'::FLOAT] || vec[5:]
       WHEN label = 3 THEN ['inf'::FLOAT] || vec[2:] ELSE vec END AS vec FROM fx_chunk"""
_MTID = """SELECT CASE WHEN l_returnflag = 'R' THEN format('u-k.{}-{:04d}', l_partkey, l_linenumber)
  ELSE format('u-k.{}-{:04d}-{}-{}', l_partkey, l_linenumber, l_suppkey, l_suppkey + 7) END AS mtid FROM lineitem"""

ORACLE = {
    "p1_predicate_filter": sql("SELECT htid, title FROM fx_meta WHERE author = 'Brand#2' AND page_count > 200", "fx_meta"),
    "p2_volume_lookup": sql("""SELECT htid, title, author, oclc_num FROM fx_meta WHERE key IN
        (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""", "fx_meta"),
    "p3_fields_offset": sql("SELECT htid, title, isbn FROM fx_meta ORDER BY htid LIMIT 500 OFFSET 100", "fx_meta"),
    "p4_meta_compare": sql("""SELECT target AS "left", candidate AS "right",
        l.title AS left_title, l.author AS left_author, l.oclc_num AS left_oclc_num, l.page_count AS left_page_count,
        l.description AS left_description, r.title AS right_title, r.author AS right_author,
        r.oclc_num AS right_oclc_num, r.page_count AS right_page_count, r.description AS right_description
        FROM fx_rel JOIN fx_meta l ON l.htid = target JOIN fx_meta r ON r.htid = candidate""", "fx_rel", "fx_meta"),
    "p5_candidate_filter": sql(f"""SELECT target, match, count, {q6s(*_STAT_COLS)} FROM stats
        WHERE count >= 2 AND mean <= 0.06 AND prop_match >= 0.3""", **_STATS),
    "p6_strong_candidates": sql(f"""SELECT target, match, count, {q6s(*_STAT_COLS)} FROM stats
        WHERE (prop_target > .5 OR prop_match > .5) AND count > 1 AND match <> target""", **_STATS),
    "p7_mean_filter": sql("SELECT target, match, round(mean + 1e-10, 6) AS mean FROM stats WHERE mean <= 0.03", **_STATS),
    "p8_high_confidence": sql(f"""SELECT 'swsm' AS rule, target, candidate, {q6s('p_swsm', 'p_swde')} FROM fx_rel
        WHERE p_swsm > 0.9 AND target < candidate UNION ALL
        SELECT 'swsm+swde', target, candidate, {q6s('p_swsm', 'p_swde')} FROM fx_rel
        WHERE p_swsm + p_swde > 0.95 AND target < candidate""", "fx_rel"),
    "p9_flip_judgments": sql(f"""SELECT least(target, candidate) AS target, greatest(target, candidate) AS candidate,
        target > candidate AS flipped,
        CASE WHEN target > candidate AND guess = 'PARTOF' THEN 'CONTAINS'
             WHEN target > candidate AND guess = 'CONTAINS' THEN 'PARTOF' ELSE guess END AS guess,
        round(CASE WHEN target > candidate THEN p_contains ELSE p_partof END + 1e-10, 6) AS p_partof,
        round(CASE WHEN target > candidate THEN p_partof ELSE p_contains END + 1e-10, 6) AS p_contains
        FROM (SELECT *, {GUESS_SQL} AS guess FROM fx_rel)""", "fx_rel"),
    "p10_guess": sql(f"SELECT target, candidate, {GUESS_SQL} AS guess FROM fx_rel", "fx_rel"),
    "p11_relatedness": sql(f"SELECT target, candidate, {q6(RELATED_SQL, 'relatedness')} FROM fx_rel", "fx_rel"),
    "p12_drop_incomplete": sql(f"""SELECT target, candidate, {q6s('p_grsim', 'p_swde')} FROM fx_rel
        WHERE p_grsim >= 0.02 AND p_swde >= 0.02""", "fx_rel"),
    "p13_types": sql("""SELECT htid, CAST(CAST(price AS FLOAT) AS DOUBLE) AS price, TRY_CAST(oclc_num AS BIGINT) AS oclc_num,
        CAST(rights_date_used AS VARCHAR) AS rights_date_used FROM fx_meta""", "fx_meta"),
    "p14_drop_nan": sql("""SELECT htid, seq, label FROM broken
        WHERE NOT list_bool_or(list_transform(vec, lambda x: isnan(x)))""", "fx_chunk", broken=_BROKEN),
    "p15_usable_unit": sql("""SELECT htid, seq, 1.0::DOUBLE AS norm, round(CAST(vec[1] AS DOUBLE) / n + 1e-10, 6) AS first FROM (
        SELECT *, sqrt(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM broken)
        WHERE n > 0 AND NOT isinf(n) AND NOT isnan(n)""", "fx_chunk", broken=_BROKEN),
    "p16_single_stream": sql("""SELECT htid, seq, min(pos) AS pos FROM (
          SELECT s.* FROM stream s JOIN (SELECT htid, min(pos) AS stop FROM (
              SELECT pos, htid, lead(htid) OVER (ORDER BY pos) AS nxt FROM stream)
            WHERE nxt IS NULL OR nxt <> htid GROUP BY htid) e ON e.htid = s.htid AND s.pos <= e.stop)
        GROUP BY htid, seq""", "fx_lines",
        stream="""SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos,
            'v.' || (part % 40) AS htid, part AS seq FROM fx_lines"""),
    "p17_dedupe_vectors": """SELECT htid, seq, b.p AS l_partkey, b.s AS l_suppkey, b.q AS l_quantity FROM (
        SELECT l_orderkey AS htid, l_linenumber AS seq,
          min({'p': l_partkey, 's': l_suppkey, 'q': l_quantity}) AS b FROM lineitem GROUP BY ALL)""",
    "p18_split_chunk_id": sql(r"""SELECT DISTINCT mtid,
        regexp_extract(mtid, '^(u-k\.\d+)-', 1) AS htid,
        CAST(regexp_extract(mtid, '^u-k\.\d+-(\d+)', 1) AS INTEGER) AS seq,
        TRY_CAST(regexp_extract(mtid, '^u-k\.\d+-\d+-(\d+)-\d+$', 1) AS INTEGER) AS start_page,
        TRY_CAST(regexp_extract(mtid, '^u-k\.\d+-\d+-\d+-(\d+)$', 1) AS INTEGER) AS end_page FROM m""", m=_MTID),
    "p19_format_chunk_id": sql("SELECT mtid, count(*) AS n FROM m GROUP BY mtid", m=_MTID),
    "p20_no_self": sql("SELECT target, count(*) AS n FROM stats WHERE target <> match GROUP BY target", **_STATS),
    "p21_work_filter": sql(f"""SELECT work_id, label_count, {q6s('gov_prop', 'serial_prop')} FROM (
        SELECT title AS work_id, count(*) AS label_count, avg(us_gov_doc_flag) AS gov_prop,
          avg(CASE WHEN bib_fmt = 'SE' THEN 1.0 ELSE 0 END) AS serial_prop FROM fx_meta GROUP BY title)
        WHERE gov_prop < .5 AND serial_prop < .5 AND label_count > 1""", "fx_meta"),
    "p22_outlier_slice": sql(f"""SELECT target, match, {q6s('mean', 'prop_target')} FROM stats,
        (SELECT quantile_cont(mean, 0.2) AS lo, quantile_cont(prop_target, 0.8) AS hi FROM stats)
        WHERE mean < lo AND prop_target > hi AND count * 3 > 2""", **_STATS),
    "p23_text_predicates": sql(f"""SELECT 'isin' AS rule, count(*) AS n FROM g WHERE guess IN ('SWSM', 'SWDE')
        UNION ALL SELECT 'regex', count(*) FROM g WHERE regexp_matches(guess, '^(SWDE|SWSM|WP)')
        UNION ALL SELECT 'prefix', count(*) FROM part WHERE starts_with(p_name, 'red')
        UNION ALL SELECT 'contains', count(*) FROM part WHERE contains(p_name, 'widget')""", "fx_rel",
        g=f"SELECT {GUESS_SQL} AS guess FROM fx_rel"),
    "p24_volume_number": sql("""SELECT htid, replace(description, 'v', 'Vol') AS raw,
        page_count // 10 AS descint FROM fx_meta WHERE us_gov_doc_flag = 0""", "fx_meta"),
    "p25_either_side": sql("""SELECT htid, count(*) AS n FROM (SELECT target AS htid FROM fx_rel
        UNION ALL SELECT candidate FROM fx_rel WHERE target <> candidate) GROUP BY htid""", "fx_rel"),
    "p26_rename": sql('SELECT target AS "left", match AS "right", count, round(mean + 1e-10, 6) AS mean FROM stats', **_STATS),
}
