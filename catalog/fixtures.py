"""Input views of the registered queries, in Spark and as SQL.

Every view reads one of the given tables in full. The Spark side is written
with the DataFrame API, the SQL side as common table expressions.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textkin.operators.bands import bands_sql
from textkin.operators import tokens as tk
from textkin.schemas import LABELS
from textkin.session import bucketed, shuffle_parts


def r6(col, name=None):
    """Six digits; the shift makes both engines round exact halves the same way."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + 1e-10, 6).alias(name or col)


def r6s(*cols):
    return [r6(c) for c in cols]


def q6(expr, name=None):
    return f"round({expr} + 1e-10, 6) AS {name or expr}"


def q6s(*cols):
    return ", ".join(q6(c) for c in cols)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def volume_id(key):
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("l"), (key % 7).cast("string"), F.lit("."), F.lpad(key.cast("string"), 12, "0"))


def sql_id(key):
    return f"('l' || ({key} % 7) || '.' || lpad(CAST({key} AS VARCHAR), 12, '0'))"


# ---- volume metadata (from part) ----------------------------------------

def meta(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        volume_id("p_partkey").alias("htid"), k.alias("key"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
        F.concat(F.lit("v."), F.col("p_size")).alias("description"),
        (F.col("p_size") * 10).alias("page_count"),
        F.when(k % 3 == 0, "allow").otherwise("deny").alias("access"),
        F.when(k % 10 == 0, 1).otherwise(0).alias("us_gov_doc_flag"),
        F.when(F.col("p_type") == "ECONOMY", "SE").otherwise("BK").alias("bib_fmt"),
        F.when(k % 11 != 0, (k % 500).cast("string")).alias("oclc_num"),
        F.when(k % 13 != 0, (k % 700).cast("string")).alias("isbn"),
        F.when(k % 5 == 0, (k % 900).cast("string")).alias("lccn"),
        (F.lit(1850) + k % 150).cast("int").alias("rights_date_used"),
        F.col("p_type").alias("imprint"), F.col("p_retailprice").alias("price"),
    )


META_SQL = f"""
SELECT {sql_id('p_partkey')} AS htid, p_partkey AS key, p_name AS title, p_brand AS author,
       'v.' || p_size AS description, p_size * 10 AS page_count,
       CASE WHEN p_partkey % 3 = 0 THEN 'allow' ELSE 'deny' END AS access,
       CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS us_gov_doc_flag,
       CASE WHEN p_type = 'ECONOMY' THEN 'SE' ELSE 'BK' END AS bib_fmt,
       CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 500 AS VARCHAR) END AS oclc_num,
       CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey % 700 AS VARCHAR) END AS isbn,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 900 AS VARCHAR) END AS lccn,
       CAST(1850 + p_partkey % 150 AS INTEGER) AS rights_date_used,
       p_type AS imprint, p_retailprice AS price
FROM part"""


# ---- directed predictions (parts on neighbouring lines of an order) -------

def lines(spark, sf):
    return _lines(table(spark, sf, "lineitem"))


def _lines(items):
    return items.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.max("l_quantity").alias("qty"))


LINES_SQL = """
SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, max(l_quantity) AS qty
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def edges(spark, sf):
    """a judges b when they stand one or two lines apart and b's quantity is at least half of a's."""
    # Orders are dealt out once; a line's two followers hold all that stand one or two lines after it, as its numbers are distinct.
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").where("l_orderkey IS NOT NULL")
    line = F.struct("l_linenumber", "part", "qty")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    after = _lines(items.repartition("l_orderkey")).select(line.alias("x"), *[F.lead(line, k).over(order).alias(f"y{k}") for k in (1, 2)])
    near = after.select("x", F.explode(F.array("y1", "y2")).alias("y")).where("y.l_linenumber - x.l_linenumber <= 2")
    both = near.select(F.explode(F.array(*[F.struct(
        F.col(f"{u}.part").alias("a"), F.col(f"{v}.part").alias("b"), F.col(f"{u}.qty").alias("qa"), F.col(f"{v}.qty").alias("qb"))
        for u, v in ("xy", "yx")])).alias("p")).select("p.*").where("a <> b AND qb * 2 >= qa")
    # Dealt by a alone, for joins on a.
    return both.select("a", "b", (F.least("qa", "qb") / F.greatest("qa", "qb")).alias("r")).repartition("a").groupBy("a", "b").agg(
        F.max("r").alias("r"))


EDGES_SQL = """
SELECT a.part AS a, b.part AS b,
       max(least(a.qty, b.qty) / greatest(a.qty, b.qty)) AS r
FROM fx_lines a JOIN fx_lines b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber - a.l_linenumber IN (-2, -1, 1, 2)
WHERE a.part <> b.part AND b.qty * 2 >= a.qty
GROUP BY a.part, b.part"""


def _weight(k):
    return f"(1 + (a * {k + 3} + b * {2 * k + 1}) % 97)"


def predictions(spark, sf):
    """Directed pairs with ten probabilities; equal titles make p_swsm decisive."""
    e = edges(spark, sf)
    name = table(spark, sf, "part").select("p_partkey", "p_name")
    e = e.join(name.toDF("a", "na"), "a").join(name.toDF("b", "nb"), "b")
    # One array column instead of ten aliases: Catalyst's constraint inference
    # would otherwise substitute every combination of the aliases into the sums.
    add = (lambda s, x: s + x)
    e = e.select(
        "a", "b", "r", (F.col("na") == F.col("nb")).alias("same"),
        F.array(*[F.expr(_weight(k)).cast("double") for k in range(10)]).alias("w"))
    e = e.withColumns({"whole": F.aggregate("w", F.lit(0.0), add),
                       "rest": F.aggregate(F.slice("w", 2, 9), F.lit(0.0), add)})
    first = F.when(F.col("same"), F.col("r")).otherwise(F.get("w", 0) / F.col("whole"))
    return e.select(
        volume_id("a").alias("target"), volume_id("b").alias("candidate"), first.alias(LABELS[0]),
        *[F.when(F.col("same"), (F.lit(1.0) - F.col("r")) * F.get("w", i) / F.col("rest")).otherwise(
            F.get("w", i) / F.col("whole")).alias(c) for i, c in list(enumerate(LABELS))[1:]])


_W = [f"CAST({_weight(k)} AS DOUBLE)" for k in range(10)]
_REST = "(0.0::DOUBLE + " + " + ".join(_W[1:]) + ")"
_WHOLE = "(0.0::DOUBLE + " + " + ".join(_W) + ")"
REL_SQL = f"""
SELECT {sql_id('a')} AS target, {sql_id('b')} AS candidate,
       CASE WHEN na.p_name = nb.p_name THEN r ELSE {_W[0]} / {_WHOLE} END AS {LABELS[0]},
       {", ".join(f"CASE WHEN na.p_name = nb.p_name THEN (1.0::DOUBLE - r) * {w} / {_REST} ELSE {w} / {_WHOLE} END AS {c}" for w, c in zip(_W[1:], LABELS[1:]))}
FROM fx_edges JOIN part na ON na.p_partkey = a JOIN part nb ON nb.p_partkey = b"""


# ---- chunk vectors (from embeddings) --------------------------------------

def chunk_vectors(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("b."), F.floor(v / 10).cast("string")).alias("htid"),
        (v % 10 + 1).cast("int").alias("seq"), F.col("embedding").alias("vec"), "label")


CHUNK_SQL = """
SELECT 'b.' || (vec_id // 10) AS htid, CAST(vec_id % 10 + 1 AS INTEGER) AS seq,
       embedding AS vec, label
FROM embeddings"""


# ---- token lists (from documents) -----------------------------------------

def docs(spark, sf, parts=None):
    """The given table is one file with one row group, which one task would read and count alone; so it is dealt out, by volume."""
    return table(spark, sf, "documents").withColumn("htid", F.concat(F.lit("d."), F.col("doc_id").cast("string"))).repartition(
        parts or shuffle_parts(spark), "htid")


def tokens(spark, sf):
    return tk.token_list(docs(spark, sf))


def token_table(spark, sf):
    """The token lists, written once in buckets by volume: nothing that keeps to volumes shuffles them again."""
    return bucketed(tokens(spark, sf), "tokens", ["htid"], shuffle_parts(spark), dealt=True)


TOKEN_SQL = r"""
SELECT htid, page, token, count(*) AS count FROM (
  SELECT htid, page, unnest(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+')) AS token FROM (
    SELECT 'd.' || doc_id AS htid, unnest(string_split(text, chr(10))) AS body,
           generate_subscripts(string_split(text, chr(10)), 1) AS page
    FROM documents))
WHERE token <> '' GROUP BY htid, page, token"""

# ---- catalogue of a second library (from part) -----------------------------
# Every volume is also a catalogue record; its similar books are the parts on
# neighbouring lines of the same orders (``edges``).


def books(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("book_id"),
        F.concat(F.upper("p_name"), F.lit(": a tale")).alias("title"),
        F.array(F.struct(F.col("p_brand").alias("author_id"))).alias("authors"))


BOOK_SQL = """
SELECT p_partkey AS book_id, upper(p_name) || ': a tale' AS title, p_brand AS author_id
FROM part"""

VIEWS = {
    "fx_meta": META_SQL, "fx_lines": LINES_SQL, "fx_edges": EDGES_SQL, "fx_rel": REL_SQL,
    "fx_chunk": CHUNK_SQL, "fx_token": TOKEN_SQL, "fx_books": BOOK_SQL,
}
NEEDS = {"fx_rel": ["fx_lines", "fx_edges"], "fx_edges": ["fx_lines"]}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` with the named views (and ad-hoc ones) as CTEs before it."""
    order = []

    def add(v):
        for need in NEEDS.get(v, []):
            add(need)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS ({q})" for k, q in extra.items()]
    recursive = "RECURSIVE " if any(f"FROM {k}" in q for k, q in extra.items()) else ""
    return (f"WITH {recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + body


# ---- document pairs (copies and versions start with the same line) ----------

def doc_pairs(spark, sf):
    """Each document with the first document that opens with the same line: star pairs."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.substring_index("text", "\n", 1)).alias("k"))
    first = d.groupBy("k").agg(F.min("doc_id").alias("first"))
    return d.join(first, "k").where("doc_id <> first").select(
        F.concat(F.lit("d."), F.col("first").cast("string")).alias("left"),
        F.concat(F.lit("d."), F.col("doc_id").cast("string")).alias("right"))


VIEWS["fx_pairs"] = """
SELECT 'd.' || f AS "left", 'd.' || doc_id AS "right" FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY split_part(text, chr(10), 1)) AS f FROM documents) WHERE f <> doc_id"""


def sign_sql(h="h", pos="pos"):
    """+1 or -1: bit ``pos`` of a digest given as hex text."""
    digit = f"substr({h}, {pos} // 4 + 1, 1)"
    return (f"CASE WHEN instr('89abcdef', {digit}) > 0 AND {pos} % 4 = 0 OR instr('4567cdef', {digit}) > 0 AND {pos} % 4 = 1 "
            f"OR instr('2367abef', {digit}) > 0 AND {pos} % 4 = 2 OR instr('13579bdf', {digit}) > 0 AND {pos} % 4 = 3 THEN 1 ELSE -1 END")


def title_views(dims=50, max_dist=None):
    """Title vectors of ``fx_meta`` (cleaning leaves its titles as they are) and their distances.

    With ``max_dist``: the distances up to there of titles that share a bucket of the banded search.
    """
    buckets = bands_sql(dims, max_dist) if max_dist else "[0]"
    return {
        "tw": r"""SELECT title, '<' || w || '>' AS w FROM (SELECT title, unnest(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+')) AS w
          FROM (SELECT DISTINCT title FROM fx_meta)) WHERE w <> ''""",
        "tg": """SELECT title, substr(w, CAST(i AS BIGINT), n) AS g, count(*) AS c FROM (SELECT title, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM tw, (VALUES (3), (4)) k(n)) GROUP BY ALL""",
        "tc": f"""SELECT title, pos, CAST(sum(c * {sign_sql()}) AS FLOAT)::DOUBLE AS x FROM (SELECT title, c, sha1(g || '#0') AS h,
          unnest(range(0, {dims})) AS pos FROM tg) GROUP BY ALL""",
        "tv": "SELECT title, list(x ORDER BY pos) AS vec, sqrt(sum(x * x)) AS n FROM tc GROUP BY title",
        "tb": f"SELECT title, unnest({buckets}) AS cell FROM tv",
        "td": """SELECT t1, t2, list_dot_product(a.vec, b.vec) / (a.n * b.n) AS cos FROM (
          SELECT DISTINCT x.title AS t1, y.title AS t2 FROM tb x JOIN tb y ON x.cell = y.cell) JOIN tv a ON a.title = t1 JOIN tv b ON b.title = t2""",
        "tn": """SELECT *, row_number() OVER (PARTITION BY target ORDER BY dist, match) - 1 AS rank FROM (
          SELECT a.htid AS target, b.htid AS match, dist FROM (SELECT *, round(sqrt(greatest(0, 2 - 2 * cos)), 7) AS dist FROM td)
          JOIN fx_meta a ON a.title = t1 JOIN fx_meta b ON b.title = t2 WHERE dist <= """ + repr(max_dist or 2.0) + ")",
    }
