"""Set operations (U)."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import sql
from catalog.joins import KEYED, RESULTS, TRUTH, _keyed, _results, rel, truth
from textkin.operators import candidates, crosswalk, evaluate, relations
from textkin.sources import sinks


def _ann(spark, sf):
    return rel(spark, sf).select("target", F.col("candidate").alias("match"))


def u1_candidate_union(spark, sf):
    meta = candidates.same_author_candidates(fx.meta(spark, sf), max_results=10)
    return candidates.all_candidates(_ann(spark, sf), meta)


def u2_noted_union(spark, sf):
    m = fx.meta(spark, sf)
    a = candidates.same_author_candidates(m, max_results=5)
    t = candidates.same_author_candidates(m.withColumn("author", F.col("title")), max_results=5).withColumn("note", F.lit("meta"))
    return a.unionByName(t).groupBy("target", "note").agg(F.count("*").alias("n"))


def u3_rule_union(spark, sf):
    m = fx.meta(spark, sf)
    ring = [candidates.value_matches(m, m, F.col(c), r, max_matches=3) for c, r in (("oclc_num", "oclc"), ("isbn", "isbn"), ("lccn", "lccn"))]
    both = ring[0].unionByName(ring[1]).unionByName(ring[2])
    return both.select("target", "match").dropDuplicates()


def u4_key_intersection(spark, sf):
    b, v = _keyed(spark, sf)
    return crosswalk.common_values(b, "code", v, "code")


def _stages(spark, sf):
    e = fx.table(spark, sf, "events")
    stage = F.when(F.col("event_type") == "signup", "ann").when(F.col("event_type") == "click", "meta").when(
        F.col("event_type") == "view", "predictions").when(F.col("event_type") == "purchase", "data")
    # A volume per user and hour: most miss some stages.
    return e.select(F.concat_ws(".", "user_id", F.hour("ts")).alias("htid"), stage.alias("stage")).where("stage IS NOT NULL")


STAGES = """SELECT user_id || '.' || hour(ts) AS htid, CASE event_type WHEN 'signup' THEN 'ann' WHEN 'click' THEN 'meta'
  WHEN 'view' THEN 'predictions' WHEN 'purchase' THEN 'data' END AS stage FROM events WHERE event_type IN ('signup', 'click', 'view', 'purchase')"""


def _targets(spark, sf):
    return fx.table(spark, sf, "events").select(F.concat_ws(".", "user_id", F.hour("ts")).alias("htid")).distinct()


def u5_stage_inventory(spark, sf):
    return relations.stage_inventory(_targets(spark, sf), _stages(spark, sf))


def u6_ingested_ids(spark, sf):
    return relations.ingested_ids(relations.flip_judgments(rel(spark, sf)))


def u7_false_positives(spark, sf):
    t = evaluate.usable_truth(truth(spark, sf))
    extra = _results(spark, sf).where("left <> right").join(t.select("left", "right"), ["left", "right"], "left_anti")
    return extra.groupBy("left").agg(F.count("*").alias("false_positives"))


def u8_array_overlap(spark, sf):
    """Members two neighbouring orders share, as array intersections of their (few) lines."""
    l = fx.lines(spark, sf).groupBy("l_orderkey").agg(F.collect_set(F.col("part") % 50).alias("m"))
    nxt = l.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("m").alias("m2"))
    return l.join(nxt, "l_orderkey").select("l_orderkey", F.size(F.array_intersect("m", "m2")).alias("shared")).where("shared BETWEEN 1 AND 2")


def u9_union_missing_columns(spark, sf):
    a = rel(spark, sf).select("target", "candidate", F.lit("real").alias("notes"))
    b = fx.edges(spark, sf).select(fx.volume_id("a").alias("target"), fx.volume_id("b").alias("candidate"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("notes").agg(F.count("*").alias("n"))


def t3_resume(spark, sf):
    done = _stages(spark, sf).where("stage = 'predictions'")
    return sinks.remaining(_targets(spark, sf), done)


QUERIES = {f.__name__: f for f in (
    u1_candidate_union, u2_noted_union, u3_rule_union, u4_key_intersection, u5_stage_inventory, u6_ingested_ids,
    u7_false_positives, u8_array_overlap, u9_union_missing_columns, t3_resume)}


def ring(col, n):
    return f"""(SELECT t.htid AS target, m.htid AS match FROM
      (SELECT htid, {col} AS v, row_number() OVER (PARTITION BY {col} ORDER BY md5('1234|' || htid), htid) - 1 AS pos, count(*) OVER (PARTITION BY {col}) AS size FROM fx_meta WHERE {col} IS NOT NULL) t,
      LATERAL (SELECT unnest(range(1, least({n}, t.size - 1) + 1)) AS step) JOIN
      (SELECT htid, {col} AS v, row_number() OVER (PARTITION BY {col} ORDER BY md5('1234|' || htid), htid) - 1 AS pos FROM fx_meta WHERE {col} IS NOT NULL) m
      ON m.v = t.v AND m.pos = (t.pos + step) % t.size)"""


_FLAGS = """SELECT htid, bool_or(stage = 'ann') AS ann, bool_or(stage = 'meta') AS meta, bool_or(stage = 'predictions') AS pred,
  bool_or(stage = 'data') AS data FROM (SELECT htid, stage FROM stages UNION ALL SELECT user_id || '.' || hour(ts), 'none' FROM events) GROUP BY htid"""

ORACLE = {
    "u1_candidate_union": sql(f"""SELECT target, match, string_agg(DISTINCT note, ',' ORDER BY note) AS notes FROM (
        SELECT target, candidate AS match, 'ann' AS note FROM fx_rel UNION ALL SELECT target, match, 'author' FROM {ring('author', 10)})
        WHERE target <> match GROUP BY target, match""", "fx_rel", "fx_meta"),
    "u2_noted_union": sql(f"""SELECT target, note, count(*) AS n FROM (SELECT target, 'author' AS note FROM {ring('author', 5)}
        UNION ALL SELECT target, 'meta' FROM {ring('title', 5)}) GROUP BY target, note""", "fx_meta"),
    "u3_rule_union": sql(f"""SELECT target, match FROM {ring('oclc_num', 3)} UNION SELECT target, match FROM {ring('isbn', 3)}
        UNION SELECT target, match FROM {ring('lccn', 3)}""", "fx_meta"),
    "u4_key_intersection": sql("SELECT code AS value FROM bk INTERSECT SELECT code FROM vo", "fx_meta", "fx_books", bk=KEYED["bk"], vo=KEYED["vo"]),
    "u5_stage_inventory": sql("""SELECT htid, 'justann' AS state FROM f WHERE ann AND NOT meta AND NOT pred
        UNION ALL SELECT htid, 'justmeta' FROM f WHERE meta AND NOT ann AND NOT pred
        UNION ALL SELECT htid, 'candidates_no_predictions' FROM f WHERE ann AND meta AND NOT pred
        UNION ALL SELECT htid, 'predictions_no_data' FROM f WHERE pred AND NOT data
        UNION ALL SELECT htid, 'data_complete' FROM f WHERE data
        UNION ALL SELECT htid, 'nocandidates' FROM f WHERE NOT ann AND NOT meta""", stages=STAGES, f=_FLAGS),
    "u6_ingested_ids": sql("SELECT DISTINCT target AS htid FROM fx_rel", "fx_rel"),
    "u7_false_positives": sql("""SELECT "left", count(*) AS false_positives FROM res r WHERE "left" <> "right" AND NOT EXISTS (
        SELECT 1 FROM truth g WHERE g."left" = r."left" AND g."right" = r."right" AND judgment NOT IN ('RANDDIFF', 'AUTHOR')) GROUP BY "left\"""",
        "fx_chunk", truth=TRUTH, res=RESULTS),
    "u8_array_overlap": sql("""SELECT l_orderkey, CAST(n AS INTEGER) AS shared FROM (SELECT a.l_orderkey, count(DISTINCT a.m) AS n FROM
        (SELECT l_orderkey, part % 50 AS m FROM fx_lines) a JOIN (SELECT l_orderkey - 1 AS l_orderkey, part % 50 AS m FROM fx_lines) b
        ON a.l_orderkey = b.l_orderkey AND a.m = b.m GROUP BY 1) WHERE n <= 2""", "fx_lines"),
    "u9_union_missing_columns": sql("SELECT 'real' AS notes, count(*) AS n FROM fx_rel UNION ALL SELECT NULL, count(*) FROM fx_edges", "fx_rel"),
    "t3_resume": sql("""SELECT DISTINCT user_id || '.' || hour(ts) AS htid FROM events
        EXCEPT SELECT htid FROM stages WHERE stage = 'predictions'""", stages=STAGES),
}
