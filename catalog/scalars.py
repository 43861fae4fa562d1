"""Scalar functions (F), over whole tables."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import q6, r6, sql
from textkin.functions import ids, labels, text
from textkin.functions import vectors as vx
from textkin.schemas import JUDGMENTS


def raw_titles(spark, sf):
    """Part names dressed as catalogue titles, the form chosen by the size."""
    p = fx.table(spark, sf, "part")
    n, b = F.col("p_name"), F.col("p_brand")
    forms = [
        n, F.concat(n, F.lit(" / by "), b), F.concat(n, F.lit(" / edited / by "), b),
        F.concat(n, F.lit("; by "), b), F.concat(n, F.lit(" [by] "), b), F.concat(n, F.lit("; illustrated by "), b),
        F.concat(n, F.lit(". Translated from the French by "), b), F.concat(n, F.lit(", by the late John Smith.")),
        F.concat(n, F.lit(". By Jane Doe and others.")), F.concat(F.lit(" "), n, F.lit(" / a / b / c.")),
        F.concat(n, F.lit(": or, The "), b, F.lit(".")),
    ]
    pick = F.element_at(F.array(*forms), (F.col("p_size") % len(forms) + 1).cast("int"))
    return p.select("p_partkey", pick.alias("raw"))


_FORMS = ["p_name", "p_name || ' / by ' || p_brand", "p_name || ' / edited / by ' || p_brand", "p_name || '; by ' || p_brand",
          "p_name || ' [by] ' || p_brand", "p_name || '; illustrated by ' || p_brand",
          "p_name || '. Translated from the French by ' || p_brand", "p_name || ', by the late John Smith.'",
          "p_name || '. By Jane Doe and others.'", "' ' || p_name || ' / a / b / c.'", "p_name || ': or, The ' || p_brand || '.'"]
RAW = f"SELECT p_partkey, CASE p_size % {len(_FORMS)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_FORMS))} END AS raw FROM part"


def clean_title_sql(t):
    t = f"regexp_replace(regexp_replace({t}, '(/[^/]*){{1,2}}$', ''), '^\\s+|\\s+$', '', 'g')"
    for s in text.TITLE_STOPS:
        t = f"split_part({t}, '{s}', 1)"
    t = f"regexp_replace({t}, '{text.CONTRIBUTOR_CLAUSE}', '', 'g')"
    t = f"regexp_replace({t}, '{text.BY_CLAUSE}', '', 'g')"
    return f"regexp_replace(regexp_replace({t}, '^\\s+|\\s+$', '', 'g'), '^\\.+|\\.+$', '', 'g')"


def f1_clean_title(spark, sf):
    return raw_titles(spark, sf).select("p_partkey", text.clean_title(F.col("raw")).alias("title"))


def raw_descriptions(spark, sf):
    n = F.col("l_linenumber").cast("string")
    q = F.col("l_quantity").cast("int").cast("string")
    forms = [F.concat(F.lit("v. "), n), F.concat(F.lit("v.00"), n), q, F.concat(F.lit("Copy "), n), F.concat(F.lit("cop."), n),
             F.concat(F.lit("Pt"), n), F.concat(F.lit("(vol. "), q, F.lit(")")), F.concat(F.lit("c"), n, F.lit(".")),
             F.concat(F.lit("v."), n, F.lit(" (pt"), q, F.lit(")"))]
    l = fx.table(spark, sf, "lineitem")
    return l.select(F.element_at(F.array(*forms), (F.col("l_partkey") % len(forms) + 1).cast("int")).alias("raw"))


_DFORMS = ["'v. ' || n", "'v.00' || n", "q", "'Copy ' || n", "'cop.' || n", "'Pt' || n", "'(vol. ' || q || ')'", "'c' || n || '.'", "'v.' || n || ' (pt' || q || ')'"]
RAWD = f"""SELECT CASE l_partkey % {len(_DFORMS)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_DFORMS))} END AS raw
  FROM (SELECT l_partkey, CAST(l_linenumber AS VARCHAR) AS n, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem)"""


def _desc_sql(c):
    c = f"lower({c})"
    for pat, rep in text.DESCRIPTION_RULES:
        rep = rep.replace("$1", "\\1").replace("$2", "\\2")
        c = f"regexp_replace({c}, '{pat}', '{rep}', 'g')"
    return c


def f2_clean_description(spark, sf):
    return raw_descriptions(spark, sf).groupBy("raw", text.clean_description(F.col("raw")).alias("description")).agg(F.count("*").alias("n"))


def _authors(spark, sf):
    c = fx.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", F.when(k % 4 == 0, F.concat(F.lit("Smith, J"), k % 90, F.lit(", 18"), F.lpad((k % 80 + 10).cast("string"), 2, "0"), F.lit("-1901.")))
                    .when(k % 4 == 1, F.concat(F.lit(" Doe, Jane, Mrs., "), "c_mktsegment")).when(k % 4 == 2, F.concat(F.lit("Mary Ann "), F.initcap("c_mktsegment")))
                    .otherwise(F.concat(F.lit("Anon"), k % 7, F.lit("."))).alias("raw"))


AUTHORS = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Smith, J' || (c_custkey % 90) || ', 18' || lpad(CAST(c_custkey % 80 + 10 AS VARCHAR), 2, '0') || '-1901.'
  WHEN 1 THEN ' Doe, Jane, Mrs., ' || c_mktsegment WHEN 2 THEN 'Mary Ann ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:])
  ELSE 'Anon' || (c_custkey % 7) || '.' END AS raw FROM customer"""


def f3_clean_author(spark, sf):
    return _authors(spark, sf).select("c_custkey", text.clean_author(F.col("raw")).alias("author"))


def f4_simple_title(spark, sf):
    return raw_titles(spark, sf).select("p_partkey", text.simple_title(F.col("raw")).alias("key"))


def f5_invert_name(spark, sf):
    return _authors(spark, sf).select("c_custkey", text.invert_name(F.col("raw")).alias("name"))


def f6_title_prefixes(spark, sf):
    return raw_titles(spark, sf).select("p_partkey", *[text.title_prefix(F.col("raw"), n).alias(f"t{n}") for n in (30, 40, 100)])


def f7_id_paths(spark, sf):
    m = fx.table(spark, sf, "pages").select("page_id", ids.path_safe(F.col("url")).alias("safe"))
    return m.withColumn("repaired", ids.repair_id(F.col("safe")))


def f8_stub_path(spark, sf):
    return fx.meta(spark, sf).select("htid", ids.stub_path(F.col("htid")).alias("path"))


def f9_parse_list(spark, sf):
    l = fx.lines(spark, sf).select("l_orderkey", F.concat(F.lit("['"), "part", F.lit("', '"), "l_linenumber", F.lit("']")).alias("raw"))
    return l.select("l_orderkey", F.explode(text.parse_int_list(F.col("raw"))).alias("id")).groupBy("l_orderkey").agg(F.sum("id").alias("total"))


def f10_list_in_known(spark, sf):
    from textkin.operators.crosswalk import keep_known

    p = fx.lines(spark, sf).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.array(F.col("part"), F.col("part") + 1).alias("members"))
    known = fx.meta(spark, sf).where("us_gov_doc_flag = 1").select("key")
    return keep_known(p, "members", known, "id", "key")


def f11_ratio_math(spark, sf):
    l = fx.table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", r6(F.ln(F.col("l_discount") + 1e-7), "log"), r6(F.try_divide("l_quantity", F.col("l_tax") * 0 + F.col("l_linenumber") - 1), "ratio"))


def f12_vector_math(spark, sf):
    c = fx.chunk_vectors(spark, sf)
    nxt = c.select("htid", (F.col("seq") - 1).alias("seq"), F.col("vec").alias("b"))
    return c.join(nxt, ["htid", "seq"]).select(
        "htid", "seq", r6(vx.dot(F.col("vec"), F.col("b")), "dot"), r6(vx.norm(F.col("vec")), "norm"),
        r6(vx.cosine(F.col("vec"), F.col("b")), "cos"), r6(vx.angular(vx.cosine(F.col("vec"), F.col("b"))), "angular"))


def f14_one_hot(spark, sf):
    g = fx.predictions(spark, sf).select("target", "candidate", labels.guess().alias("guess"))
    return g.select("target", "candidate", F.array_join(labels.one_hot(F.col("guess")), "").alias("y"))


def f15_confidence(spark, sf):
    return fx.predictions(spark, sf).select("target", "candidate", labels.confidence(F.round(F.col("p_swsm"), 9)).alias("confidence"))


def f16_volume_link(spark, sf):
    return fx.meta(spark, sf).select(ids.volume_link(F.col("htid")).alias("link"))


def f17_content_id(spark, sf):
    """Id of the ordered pair of volumes on each prediction."""
    return fx.predictions(spark, sf).select("target", "candidate", ids.content_id(F.array("target", "candidate")).alias("id"))


def f18_page_range(spark, sf):
    return fx.tokens(spark, sf).groupBy("htid").agg(ids.page_range(F.min("page"), F.max("page")).alias("pages"))


def f20_numeric_repair(spark, sf):
    m = fx.meta(spark, sf).withColumn("raw", F.when(F.col("page_count") > 400, "None").when(F.col("page_count") < 50, "n/a").otherwise(F.col("page_count").cast("string")))
    return m.select("htid", text.numeric_or_null(F.col("raw")).alias("pages"))


def f21_tokenise(spark, sf):
    return fx.tokens(spark, sf).groupBy("token").agg(F.sum("count").alias("n"), F.count_distinct("htid").alias("docs"))


QUERIES = {f.__name__: f for f in (
    f1_clean_title, f2_clean_description, f3_clean_author, f4_simple_title, f5_invert_name, f6_title_prefixes, f7_id_paths,
    f8_stub_path, f9_parse_list, f10_list_in_known, f11_ratio_math, f12_vector_math, f14_one_hot, f15_confidence,
    f16_volume_link, f17_content_id, f18_page_range, f20_numeric_repair, f21_tokenise)}

_STUB = """list_aggregate([substr(substr(htid, strpos(htid, '.') + 1), CAST(i AS BIGINT), 1)
  FOR i IN range(1, len(htid) - strpos(htid, '.') + 1, 3)], 'string_agg', '')"""
_EDGE = r"regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '^\.+|\.+$', '', 'g')"
from catalog.filters import GUESS_SQL  # noqa: E402

ORACLE = {
    "f1_clean_title": sql(f"SELECT p_partkey, {clean_title_sql('raw')} AS title FROM raws", raws=RAW),
    "f2_clean_description": sql(f"SELECT raw, {_desc_sql('raw')} AS description, count(*) AS n FROM raws GROUP BY ALL", raws=RAWD),
    "f3_clean_author": sql(f"""SELECT c_custkey, array_to_string(string_split({_EDGE.format("regexp_replace(raw, '-?[0-9]{4}', '', 'g')")}, ',')[1:2], ',') AS author FROM raws""", raws=AUTHORS),
    "f4_simple_title": sql(rf"""SELECT p_partkey, substr(regexp_replace(regexp_replace(lower({clean_title_sql('raw')}), '[:/\\].*$', ''), '[^\p{{L}}\p{{N}}_]', '', 'g'), 1, 35) AS key FROM raws""", raws=RAW),
    "f5_invert_name": sql(r"SELECT c_custkey, regexp_replace(raw, '^(.*) ([A-Z].*)$', '\2, \1') AS name FROM raws", raws=AUTHORS),
    "f6_title_prefixes": sql("SELECT p_partkey, raw[1:30] AS t30, raw[1:40] AS t40, raw[1:100] AS t100 FROM raws", raws=RAW),
    "f7_id_paths": "SELECT page_id, translate(url, '/:', '=+') AS safe, translate(translate(url, '/:', '=+'), '=', '/') AS repaired FROM pages",
    "f8_stub_path": sql(f"SELECT htid, split_part(htid, '.', 1) || '/' || {_STUB} || '/' || htid AS path FROM fx_meta", "fx_meta"),
    "f9_parse_list": sql("SELECT l_orderkey, CAST(sum(part + l_linenumber) AS BIGINT) AS total FROM fx_lines GROUP BY 1", "fx_lines"),
    "f10_list_in_known": sql("""SELECT DISTINCT member, id FROM (SELECT l_orderkey || '-' || l_linenumber AS id, unnest([part, part + 1]) AS member FROM fx_lines)
        WHERE member IN (SELECT key FROM fx_meta WHERE us_gov_doc_flag = 1)""", "fx_lines", "fx_meta"),
    "f11_ratio_math": f"""SELECT l_orderkey, l_linenumber, {q6('ln(l_discount + 1e-7)', 'log')}, {q6('l_quantity / nullif(l_linenumber - 1, 0)', 'ratio')} FROM lineitem""",
    "f12_vector_math": sql(f"""SELECT a.htid, a.seq, {q6('list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])', 'dot')},
        {q6('sqrt(list_dot_product(a.vec::DOUBLE[], a.vec::DOUBLE[]))', 'norm')}, {q6('list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[])', 'cos')},
        {q6('sqrt(2 - 2 * list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]))', 'angular')} FROM fx_chunk a JOIN fx_chunk b ON a.htid = b.htid AND b.seq = a.seq + 1""", "fx_chunk"),
    "f14_one_hot": sql(f"""SELECT target, candidate, {" || ".join(f"CASE WHEN g = '{j}' THEN '1' ELSE '0' END" for j in JUDGMENTS)} AS y
        FROM (SELECT target, candidate, {GUESS_SQL} AS g FROM fx_rel)""", "fx_rel"),
    "f15_confidence": sql("SELECT target, candidate, CAST(trunc(round(p_swsm, 9) * 100) AS INTEGER) AS confidence FROM fx_rel", "fx_rel"),
    "f16_volume_link": sql("SELECT 'http://hdl.handle.net/2027/' || htid AS link FROM fx_meta", "fx_meta"),
    "f17_content_id": sql("SELECT target, candidate, 'fake.' || substr(md5(target || ',' || candidate), 1, 6) AS id FROM fx_rel", "fx_rel"),
    "f18_page_range": sql("SELECT htid, min(page) || '-' || max(page) AS pages FROM fx_token GROUP BY htid", "fx_token"),
    "f20_numeric_repair": sql("SELECT htid, CASE WHEN page_count BETWEEN 50 AND 400 THEN CAST(page_count AS DOUBLE) END AS pages FROM fx_meta", "fx_meta"),
    "f21_tokenise": sql("SELECT token, CAST(sum(count) AS BIGINT) AS n, count(DISTINCT htid) AS docs FROM fx_token GROUP BY token", "fx_token"),
}
