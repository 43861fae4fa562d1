"""Window-like operators (E) and sorts, limits, samples (L)."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.filters import stats
from catalog.fixtures import q6, r6, r6s, sql
from catalog.joins import rel
from textkin.functions import labels
from textkin.operators import ranks, synthesis
from textkin.operators import tokens as tk
from textkin.schemas import LABELS


def e3_first_per_group(spark, sf):
    """Cheapest line of every part, ties by order and line."""
    l = fx.table(spark, sf, "lineitem")
    best = l.groupBy("l_partkey").agg(F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("b"))
    return best.select("l_partkey", "b.*")


def e4_running_tokens(spark, sf):
    return tk.running_counts(fx.tokens(spark, sf)).select("htid", "page", "n_tokens", "running")


def e5_page_cap(spark, sf):
    """Volumes of an author and title, in price order, while their pages stay under the cap."""
    m = fx.meta(spark, sf).select("author", "title", "key", "page_count")
    placed = ranks.positions(m, ["author", "title"], F.floor(F.col("key") / 64), ["key"])
    run = ranks.running_total(placed, ["author", "title"], "pos", "page_count", "pages")
    return run.where(F.col("pages") < 742).select("author", "title", "key", "pages")


def e6_consecutive_numbers(spark, sf):
    return synthesis.consecutive_groups(fx.meta(spark, sf)).select("htid", "descint")


def e7_islands(spark, sf):
    n = synthesis.consecutive_groups(fx.meta(spark, sf))
    isl = synthesis.volume_islands(n, max_len=100000)
    return isl.groupBy("author", "title", "island").agg(
        F.min("descint").alias("first"), F.max("descint").alias("last"), F.count("*").alias("size")).drop("island")


def _parts(spark, sf):
    """Documents joined in threes: part number = doc_id mod 3."""
    t = fx.tokens(spark, sf)
    d = F.substring_index("htid", ".", -1).cast("long")
    return t.select(F.floor(d / 3).alias("new_id"), (d % 3).alias("part_no"), F.col("page").cast("long").alias("page"), "token", "count")


def e8_renumber_pages(spark, sf):
    return tk.renumber(_parts(spark, sf)).groupBy("new_id", "page").agg(F.sum("count").alias("n"))


def e9_chunks(spark, sf):
    return tk.chunks(fx.tokens(spark, sf), 200)


def e11_cap_per_group(spark, sf):
    m = fx.meta(spark, sf).select("htid", "author")
    from textkin.functions.ids import shuffle_key

    return ranks.top_per_group(m.withColumn("k", shuffle_key(F.col("htid"))), ["author"], ["k", "htid"], 5).select("author", "htid")


def e12_singleton_numbers(spark, sf):
    from textkin.operators.graph import single_clusters

    r = rel(spark, sf)
    labelled = r.where("p_swsm > 0.5").select(F.explode(F.array("target", "candidate")).alias("id")).distinct()
    return single_clusters(r, labelled, 1000)


def l1_label_sort(spark, sf):
    r = rel(spark, sf)
    rounded = r.select("target", "candidate", *[F.round(c, 9).alias(c) for c in LABELS])
    top = rounded.orderBy(*[F.desc(c) for c in LABELS], "target", "candidate").limit(500)
    return top.select("target", "candidate", *r6s("p_swsm", "p_randdiff"))


def l2_count_mean_sort(spark, sf):
    return stats(spark, sf).orderBy(F.desc("count"), F.desc("mean"), "target", "match").limit(300).select(
        "target", "match", "count", r6("mean"))


def l5_order_limit(spark, sf):
    return fx.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(50).select(
        "o_orderkey", "o_totalprice")


def l6_sample_rows(spark, sf):
    m = fx.meta(spark, sf).select("htid")
    exact = ranks.sample_rows(m, 100, ["htid"]).withColumn("kind", F.lit("rows"))
    share = ranks.sample_fraction(m, 0.25, ["htid"]).withColumn("kind", F.lit("fraction"))
    return exact.unionByName(share)


def l7_sample_groups(spark, sf):
    return ranks.sample_groups(fx.meta(spark, sf).select("htid", "author"), "author", 7)


def l8_slice(spark, sf):
    return ranks.slice_positions(fx.meta(spark, sf).select("htid"), 50, 150, ["htid"])


QUERIES = {f.__name__: f for f in (
    e3_first_per_group, e4_running_tokens, e5_page_cap, e6_consecutive_numbers, e7_islands, e8_renumber_pages, e9_chunks,
    e11_cap_per_group, e12_singleton_numbers, l1_label_sort, l2_count_mean_sort, l5_order_limit,
    l6_sample_rows, l7_sample_groups, l8_slice)}

from catalog.filters import STATS_SQL  # noqa: E402

PAGES = "SELECT htid, page, CAST(sum(count) AS BIGINT) AS n_tokens FROM fx_token GROUP BY ALL"
RUNNING = """SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY htid ORDER BY page) AS BIGINT) AS running FROM pages"""
CHUNK_PAGES = {
    "pages": PAGES, "running": RUNNING,
    "raw": "SELECT *, (running - n_tokens) // {n} AS raw FROM running",
    "sizes": """SELECT htid, raw, sum(n_tokens) AS size, row_number() OVER (PARTITION BY htid ORDER BY raw) AS k,
        lead(raw) OVER (PARTITION BY htid ORDER BY raw) IS NULL AS last FROM raw GROUP BY htid, raw""",
    "chunk_pages": """SELECT raw.htid, page, n_tokens, CAST(CASE WHEN last AND k > 1 AND size * 2 < {n} THEN k - 1 ELSE k END AS INTEGER) AS seq
        FROM raw JOIN sizes ON raw.htid = sizes.htid AND raw.raw = sizes.raw""",
}


def chunk_ctes(n):
    return {k: v.replace("{n}", str(n)) for k, v in CHUNK_PAGES.items()}


_CONSEC = """SELECT htid, author, title, page_count, page_count // 10 AS descint FROM fx_meta m WHERE EXISTS (
  SELECT 1 FROM fx_meta a JOIN fx_meta b ON a.author = b.author AND a.title = b.title AND b.page_count = a.page_count + 10
  WHERE a.author = m.author AND a.title = m.title)"""

ORACLE = {
    "e3_first_per_group": """SELECT l_partkey, l_extendedprice, l_orderkey, l_linenumber FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1""",
    "e4_running_tokens": sql("SELECT htid, CAST(page AS INTEGER) AS page, n_tokens, running FROM running", "fx_token", pages=PAGES, running=RUNNING),
    "e5_page_cap": sql("""SELECT author, title, key, pages FROM (SELECT *, CAST(sum(page_count) OVER (PARTITION BY author, title ORDER BY key) AS BIGINT) AS pages
        FROM fx_meta) WHERE pages < 742""", "fx_meta"),
    "e6_consecutive_numbers": sql("SELECT htid, descint FROM c", "fx_meta", c=_CONSEC),
    "e7_islands": sql("""SELECT author, title, min(descint) AS first, max(descint) AS last, count(*) AS size FROM (
        SELECT author, title, descint, descint - row_number() OVER (PARTITION BY author, title ORDER BY descint) AS island
        FROM (SELECT DISTINCT author, title, descint FROM c)) GROUP BY author, title, island HAVING count(*) > 1""", "fx_meta", c=_CONSEC),
    "e8_renumber_pages": sql("""SELECT new_id, page + shift AS page, CAST(sum(count) AS BIGINT) AS n FROM p JOIN (
          SELECT new_id, part_no, CAST(coalesce(sum(hi - lo + 1) OVER (PARTITION BY new_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) - lo + 1 AS shift
          FROM (SELECT new_id, part_no, min(page) AS lo, max(page) AS hi FROM p GROUP BY ALL)) USING (new_id, part_no) GROUP BY 1, 2""", "fx_token",
        p="""SELECT CAST(substr(htid, 3) AS BIGINT) // 3 AS new_id, CAST(substr(htid, 3) AS BIGINT) % 3 AS part_no, page, token, count FROM fx_token"""),
    "e9_chunks": sql("""SELECT htid, seq, CAST(min(page) AS INTEGER) AS start_page, CAST(max(page) AS INTEGER) AS end_page,
        CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM chunk_pages GROUP BY htid, seq""", "fx_token", **chunk_ctes(200)),
    "e11_cap_per_group": sql("""SELECT author, htid FROM fx_meta QUALIFY row_number() OVER (PARTITION BY author ORDER BY md5('1234|' || htid), htid) <= 5""", "fx_meta"),
    "e12_singleton_numbers": sql("""SELECT row_number() OVER (ORDER BY md5('1234|' || id), id) - 1 + 1000 AS label, id FROM (
        SELECT target AS id FROM fx_rel UNION SELECT candidate FROM fx_rel)
        WHERE id NOT IN (SELECT target FROM fx_rel WHERE p_swsm > 0.5 UNION SELECT candidate FROM fx_rel WHERE p_swsm > 0.5)""", "fx_rel"),
    "l1_label_sort": sql(f"""SELECT target, candidate, {q6('p_swsm')}, {q6('p_randdiff')} FROM (
        SELECT target, candidate, {", ".join(f"round({c}, 9) AS {c}" for c in LABELS)} FROM fx_rel
        ORDER BY {", ".join(str(i + 3) + " DESC" for i in range(10))}, target, candidate LIMIT 500)""", "fx_rel"),
    "l2_count_mean_sort": sql(f"""SELECT target, match, count, {q6('mean')} FROM (SELECT * FROM stats
        ORDER BY count DESC, mean DESC, target, match LIMIT 300)""", stats=STATS_SQL),
    "l5_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10",
    "l6_sample_rows": sql("""(SELECT htid, 'rows' AS kind FROM fx_meta ORDER BY md5('1234|' || htid), htid LIMIT 100)
        UNION ALL SELECT htid, 'fraction' FROM fx_meta WHERE substr(md5('1234|' || htid), 1, 8) < '40000000'""", "fx_meta"),
    "l7_sample_groups": sql("""SELECT htid, author FROM fx_meta WHERE author IN (SELECT author FROM (SELECT DISTINCT author FROM fx_meta)
        ORDER BY md5('1234|' || author), author LIMIT 7)""", "fx_meta"),
    "l8_slice": sql("SELECT htid FROM fx_meta ORDER BY md5('1234|' || htid), htid LIMIT 100 OFFSET 50", "fx_meta"),
}
