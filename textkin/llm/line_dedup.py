"""Line dedup by site-relative frequency: a line that too large a part of a host's pages hold is boilerplate.

A page is a row with text and host; its lines are split at ``\\n`` and compared without outer spaces. Blank lines are
never counted nor dropped. A line is dropped on a host if at least ``min_pages`` of its pages hold it and their number
divided by all pages of the host exceeds ``ratio``.

Nulls and edges: rows without host or text come back as they were, with 0 lines dropped (null text: 0 lines). Repeated
rows are pages of their own, unless ``distinct`` counts equal texts of a host once, or ``page`` names a column whose equal values
stand for one page (null: the text). A page of nothing but boilerplate keeps its row, with empty text, or as it was with ``spare``. Tables without rows give no rows. All other columns pass through,
whatever their names.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.llm.tables import fresh, join_lookup

RATIO = 0.05
MIN_PAGES = 5


def _keys(text):
    """Hash of each line of a page; null for blank lines."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate(docs: DataFrame, host="source", text="text", ratio=RATIO, min_pages=MIN_PAGES, distinct=False, page=None) -> DataFrame:
    """``(host, line_keys)`` of the hosts that have boilerplate; ``distinct`` counts equal texts of a host as one page, ``page``
    the rows of a host that agree in that column. A line of a page counts where any of its rows holds it.

    A host's list is bounded: its lines fill at most the lines of an average page divided by ``ratio``. Lines are
    counted before the shuffle, so a host with a third of all pages sends each line once per task.
    """
    own_text = F.xxhash64(text)
    same = F.when(F.col(page).isNotNull(), F.xxhash64(F.lit("page"), F.col(page))).otherwise(own_text) if page else own_text
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"), same.alias("page"))
    pages = pages.where("host is not null and text is not null")
    own = F.explode(F.array_compact(F.array_distinct(_keys(F.col("text"))))).alias("line")
    if distinct or page:
        # Lines stand for their page by its hash, so no text is shuffled.
        lines, pages = pages.select("host", "page", own).distinct(), pages.select("host", "page").distinct()
    else:
        lines = pages.select("host", own)
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return (counted.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
            .groupBy("host").agg(F.collect_set("line").alias("line_keys")))


def drop_boilerplate(docs: DataFrame, host="source", text="text", ratio=RATIO, min_pages=MIN_PAGES,
                     n_lines="n_lines", n_dropped="n_dropped", distinct=False, spare=False, bad_lines=None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and the lines counted before and dropped.

    The names of the two counts get underscores if ``docs`` has such columns. ``distinct``: copies of a text count as one
    page of their host. ``spare``: a page that would lose all its non-blank lines is left as it was. ``bad_lines``: the table
    that ``boilerplate`` gave, where it was made with other arguments.
    """
    n_lines, n_dropped = fresh(docs, n_lines), fresh(docs, n_dropped)
    key, bad, kept = (fresh(docs, n) for n in ("host_key", "line_keys", "kept_lines"))
    lookup = boilerplate(docs, host, text, ratio, min_pages, distinct) if bad_lines is None else bad_lines
    lookup = lookup.toDF(key, bad)
    lines = F.split(F.col(text), "\n", -1)
    keep = F.filter(lines, lambda x: ~F.coalesce(
        F.array_contains(F.col(bad), F.when(F.trim(x) != "", F.xxhash64(F.trim(x)))), F.lit(False)))
    joined = join_lookup(docs, lookup, F.col(host) == F.col(key), name="boilerplate")
    joined = joined.withColumn(kept, F.when(F.col(bad).isNotNull(), keep))
    if spare:
        joined = joined.withColumn(kept, F.when(F.exists(kept, lambda x: F.trim(x) != ""), F.col(kept)))
    total = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    return joined.select(*[F.coalesce(F.array_join(kept, "\n"), F.col(c)).alias(c) if c == text else F.col(c)
                           for c in docs.columns],
                         total.cast("long").alias(n_lines),
                         F.when(F.col(kept).isNull(), 0).otherwise(total - F.size(kept)).cast("long").alias(n_dropped))
