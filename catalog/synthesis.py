"""Synthetic volumes (Y)."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import sql
from textkin.operators import synthesis
from textkin.operators import tokens as tk


def _numbered(spark, sf):
    return synthesis.consecutive_groups(fx.meta(spark, sf))


def _choices(spark, sf):
    pool = synthesis.short_book_pool(fx.meta(spark, sf).select("htid", "author", "title", "page_count"))
    return synthesis.anthology_choices(pool)


def y1_anthology_choices(spark, sf):
    return _choices(spark, sf)


def y2_consecutive_volumes(spark, sf):
    return synthesis.volume_islands(_numbered(spark, sf)).select("author", "title", "part_no", "descint", "htid", "pages")


def _doc_parts(spark, sf):
    """Synthetic volumes of three documents each."""
    d = fx.table(spark, sf, "documents")
    return d.select(F.concat(F.lit("s."), F.floor(F.col("doc_id") / 3)).alias("new_id"), (F.col("doc_id") % 3).cast("int").alias("part_no"),
                    F.concat(F.lit("d."), "doc_id").alias("htid"))


def y3_assemble_volumes(spark, sf):
    out = synthesis.assemble(_doc_parts(spark, sf), fx.tokens(spark, sf), 3, 3)
    return out.groupBy("new_id").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.sum("count").alias("tokens"))


def y3_source_notes(spark, sf):
    return synthesis.source_notes(_doc_parts(spark, sf), fx.tokens(spark, sf), max_start=3, max_end=3)


def y4_ground_truth(spark, sf):
    parts = _doc_parts(spark, sf).select("new_id", "htid")
    lines = fx.lines(spark, sf).select(F.floor(F.col("l_orderkey") / 2).cast("string").alias("author"), (F.col("l_orderkey") % 2 + 1).alias("draw"),
                                       F.concat(F.lit("o."), "l_orderkey").alias("new_id"), (F.col("part") % 20).cast("string").alias("htid")).distinct()
    return synthesis.contains_truth(parts).unionByName(synthesis.overlap_truth(lines))


def y5_short_book_pool(spark, sf):
    return synthesis.short_book_pool(fx.meta(spark, sf).select("htid", "author", "title", "page_count"))


def e10_split_parts(spark, sf):
    s = tk.split_parts(fx.tokens(spark, sf), 3, 3)
    return s.groupBy("htid", "part").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.sum("count").alias("n"))


QUERIES = {f.__name__: f for f in (
    e10_split_parts, y1_anthology_choices, y2_consecutive_volumes, y3_assemble_volumes, y3_source_notes, y4_ground_truth, y5_short_book_pool)}

_CONSEC = """SELECT htid, author, title, page_count, page_count // 10 AS descint FROM fx_meta m WHERE EXISTS (
  SELECT 1 FROM fx_meta a JOIN fx_meta b ON a.author = b.author AND a.title = b.title AND b.page_count = a.page_count + 10
  WHERE a.author = m.author AND a.title = m.title)"""
_PICK = """SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY author, title, descint ORDER BY md5('1234|' || htid), htid) = 1"""
_ISL = """SELECT *, descint - row_number() OVER (PARTITION BY author, title ORDER BY descint) AS island FROM pick"""
_RUN = """SELECT *, CAST(sum(page_count) OVER (PARTITION BY author, title, island ORDER BY descint) AS BIGINT) AS pages FROM isl QUALIFY pages < 742"""
CUTS = """SELECT htid, lo, hi, CASE WHEN f < b THEN f ELSE lo END AS front_end, CASE WHEN f < b THEN b ELSE hi END AS back_start FROM (
  SELECT *, lo + CAST('0x' || substr(md5('1234|' || htid), 1, 6) AS BIGINT) % (greatest(least(3 - lo, hi - lo), 0) + 1) AS f,
    hi - CAST('0x' || substr(md5('1234|' || htid), 7, 6) AS BIGINT) % (least(3, hi - lo) + 1) AS b
  FROM (SELECT htid, min(page) AS lo, max(page) AS hi FROM fx_token GROUP BY htid))"""
SPLIT = """SELECT t.*, CASE WHEN page <= front_end THEN 'front' WHEN page < back_start THEN 'center' ELSE 'back' END AS part FROM fx_token t JOIN cuts USING (htid)"""
_PARTS = "SELECT 's.' || (doc_id // 3) AS new_id, CAST(doc_id % 3 AS INTEGER) AS part_no, 'd.' || doc_id AS htid FROM documents"

ORACLE = {
    "y2_consecutive_volumes": sql("""SELECT author, title, CAST(row_number() OVER (PARTITION BY author, title, island ORDER BY descint) AS INTEGER) AS part_no,
        descint, htid, pages FROM run QUALIFY count(*) OVER (PARTITION BY author, title, island) > 1""", "fx_meta", c=_CONSEC, pick=_PICK, isl=_ISL, run=_RUN),
    "y3_assemble_volumes": sql("""SELECT new_id, CAST(1 AS BIGINT) AS first, CAST(sum(hi - lo + 1) AS BIGINT) AS last, CAST(sum(n) AS BIGINT) AS tokens FROM (
        SELECT new_id, p, min(page) AS lo, max(page) AS hi, sum(count) AS n FROM (
          SELECT new_id, CASE part WHEN 'front' THEN -1 WHEN 'back' THEN 9 ELSE part_no END AS p, page, count FROM parts JOIN split USING (htid)
          WHERE part = 'center' OR part_no = first_no) GROUP BY ALL) GROUP BY new_id""", "fx_token", cuts=CUTS, split=SPLIT,
        parts0=_PARTS, parts="SELECT *, min(part_no) OVER (PARTITION BY new_id) AS first_no FROM parts0 WHERE htid IN (SELECT htid FROM fx_token)"),
    "e10_split_parts": sql("""SELECT htid, part, CAST(min(page) AS INTEGER) AS lo, CAST(max(page) AS INTEGER) AS hi, CAST(sum(count) AS BIGINT) AS n
        FROM split GROUP BY htid, part""", "fx_token", cuts=CUTS, split=SPLIT),
    "y3_source_notes": sql("""SELECT new_id, part_no, htid, part, min(page) || '-' || max(page) AS pages FROM parts0 JOIN split USING (htid)
        GROUP BY new_id, part_no, htid, part""", "fx_token", cuts=CUTS, split=SPLIT, parts0=_PARTS),
    "y4_ground_truth": sql("""SELECT new_id AS "left", htid AS "right", 'CONTAINS' AS judgment, 'fake anthology' AS notes FROM parts0
        UNION ALL SELECT htid, new_id, 'PARTOF', 'fake anthology' FROM parts0
        UNION ALL SELECT unnest([a, b]), unnest([b, a]), 'OVERLAPS', 'fake overlap' FROM (
          SELECT x.o AS a, y.o AS b FROM (SELECT DISTINCT l_orderkey AS k, 'o.' || l_orderkey AS o, part % 20 AS m FROM fx_lines WHERE l_orderkey % 2 = 0) x
          JOIN (SELECT DISTINCT l_orderkey - 1 AS k, 'o.' || l_orderkey AS o, part % 20 AS m FROM fx_lines WHERE l_orderkey % 2 = 1) y
          ON x.k = y.k AND x.m = y.m GROUP BY 1, 2 HAVING count(*) <= 2)""", "fx_lines", parts0=_PARTS),
    "y5_short_book_pool": sql("""SELECT * FROM one WHERE author IN (SELECT author FROM one GROUP BY author HAVING count(title) >= 3)""", "fx_meta",
        one="""SELECT (min({'h': htid, 'p': page_count})).h AS htid, author, title, (min({'h': htid, 'p': page_count})).p AS page_count FROM fx_meta
          WHERE page_count < (SELECT quantile_cont(page_count, 0.4) FROM fx_meta) GROUP BY author, title"""),
}
