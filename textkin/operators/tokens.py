"""Token lists, chunks, page sets and page renumbering.

A token list is a long table ``(htid, page, token, count)``.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textkin.functions.text import text_tokens
from textkin.operators.ranks import positions, running_total
from textkin.session import cut


def token_list(docs: DataFrame, htid="htid", text="text", page_break="\n") -> DataFrame:
    """Split whole texts into pages and count lower-case tokens per page."""
    texts = docs.select(F.col(htid).alias("htid"), F.col(text).alias("text"))
    pages = texts.select("htid", F.posexplode(F.split("text", page_break)).alias("page0", "body"))
    return (
        pages.select("htid", (F.col("page0") + 1).alias("page"),
                     F.explode(text_tokens(F.col("body"))).alias("token"))
        .groupBy("htid", "page", "token").agg(F.count("*").alias("count"))
    )


def page_totals(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("htid", "page").agg(F.sum("count").alias("n_tokens"))


def token_sets(tokens: DataFrame, scope=("htid", "page")) -> DataFrame:
    """Distinct tokens per page or chunk, one row per member."""
    return tokens.select(*scope, "token").distinct()


def running_counts(tokens: DataFrame) -> DataFrame:
    """Tokens on each page and up to its end.

    The page totals, one row per page, are written once; everything after reads
    them instead of the tokens.
    """
    return running_total(cut(page_totals(tokens), "pages"), ["htid"], "page", "n_tokens", "running")


def chunk_pages(tokens: DataFrame, chunk_size=10000) -> DataFrame:
    """Chunk number (from 1) and chunk size of every page.

    A chunk closes when ``chunk_size`` tokens have passed; a short last chunk
    (under half the size) joins the one before it.
    """
    pages = running_counts(tokens).withColumn(
        "raw", F.floor((F.col("running") - F.col("n_tokens")) / chunk_size))
    # Chunk numbers with no page of their own would leave gaps, so number the used ones.
    # One row per chunk of a volume.
    sizes = pages.groupBy("htid", "raw").agg(F.sum("n_tokens").alias("size"))
    numbered = positions(sizes, ["htid"], F.floor(F.col("raw") / 1024), ["raw"], pos="k", size="n_raw")
    numbered = numbered.withColumn("last", F.col("k") == F.col("n_raw") - 1).withColumn(
        "short", F.col("last") & (F.col("k") > 0) & (F.col("size") * 2 < chunk_size)).withColumn(
        "seq", (F.col("k") + F.when(F.col("short"), 0).otherwise(1)).cast("int"))
    totals = numbered.groupBy("htid", "seq").agg(F.sum("size").alias("chunk_tokens"))
    placed = numbered.select("htid", "raw", "seq").join(totals, ["htid", "seq"])
    return pages.join(placed, ["htid", "raw"]).select("htid", "page", "seq", "n_tokens", "chunk_tokens")


def page_extents(pages: DataFrame) -> DataFrame:
    """Page range and size of every chunk, from ``chunk_pages``."""
    return pages.groupBy("htid", "seq").agg(
        F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.sum("n_tokens").alias("n_tokens"))


def chunks(tokens: DataFrame, chunk_size=10000) -> DataFrame:
    """Page range and size of every chunk."""
    return page_extents(chunk_pages(tokens, chunk_size))


def count_by_chunk(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Token counts per chunk; ``chunk_tokens`` is the chunk's size.

    ``pages`` comes from ``chunk_pages``, so a chunk is a range of pages. A volume's ranges, one entry per chunk, meet its tokens, which
    stay where they are dealt by volume and need no order; a token finds its range by bisection.
    """
    spans = pages.groupBy("htid", "seq").agg(
        F.min("page").alias("low"), F.max("page").alias("high"), F.max("chunk_tokens").alias("chunk_tokens"))
    lists = spans.groupBy("htid").agg(F.sort_array(F.collect_list(F.struct("low", "high", "seq", "chunk_tokens"))).alias("spans"))
    powers = F.sequence(F.floor(F.log2(F.size("spans"))).cast("int"), F.lit(0), F.lit(-1))
    lists = lists.select("htid", "spans", F.col("spans.low").alias("lows"), F.transform(powers, lambda k: F.pow(F.lit(2), k).cast("int")).alias("steps"))
    at = F.reduce("steps", F.lit(0), lambda i, s: F.when(F.get("lows", i + s) <= F.col("page"), i + s).otherwise(i))
    return (
        tokens.join(lists.hint("shuffle_hash"), "htid").select("htid", "page", "token", "count", F.get("spans", at).alias("c"))
        .where(F.col("page").between(F.col("c.low"), F.col("c.high")))
        .groupBy("htid", "c.seq", "token").agg(F.sum("count").alias("count"), F.max("c.chunk_tokens").alias("chunk_tokens"))
    )


def chunk_token_list(tokens: DataFrame, chunk_size=10000) -> DataFrame:
    return count_by_chunk(tokens, chunk_pages(tokens, chunk_size))


def page_bounds(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("htid").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def cut_points(tokens: DataFrame, max_start=10, max_end=10, seed=1234) -> DataFrame:
    """Pseudo-random end of the front matter and start of the back matter.

    The front ends within the first ``max_start`` pages, the back starts within
    the last ``max_end``; volumes too short for both keep their first and last
    page as the outer parts.
    """
    b = page_bounds(tokens)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "htid")), 1, 6), 16, 10).cast("long")
    draw2 = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "htid")), 7, 6), 16, 10).cast("long")
    span = F.col("last_page") - F.col("first_page")
    front_room = F.greatest(F.least(F.lit(max_start) - F.col("first_page"), span), F.lit(0))
    back_room = F.least(F.lit(max_end), span)
    front = F.col("first_page") + F.pmod(draw, front_room + 1)
    back = F.col("last_page") - F.pmod(draw2, back_room + 1)
    return b.withColumn("front_end", front).withColumn("back_start", back).withColumns({
        "front_end": F.when(front < back, front).otherwise(F.col("first_page")),
        "back_start": F.when(front < back, back).otherwise(F.col("last_page")),
    }).select("htid", "first_page", "last_page",
              F.col("front_end").cast("long").alias("front_end"),
              F.col("back_start").cast("long").alias("back_start"))


def split_parts(tokens: DataFrame, max_start=10, max_end=10, seed=1234) -> DataFrame:
    """Label every token row front, center or back; ranges do not overlap."""
    cuts = cut_points(tokens, max_start, max_end, seed).drop("first_page", "last_page")
    return tokens.join(cuts, "htid").withColumn(
        "part",
        F.when(F.col("page") <= F.col("front_end"), "front")
        .when(F.col("page") < F.col("back_start"), "center").otherwise("back"))


def renumber(parts: DataFrame, new_id="new_id", order="part_no") -> DataFrame:
    """Concatenate token lists: pages of part k follow those of part k-1.

    ``parts`` holds ``(new_id, part_no, page, token, count)``. The page extents
    (one row per part) are offset by a running sum and joined back.
    """
    ext = parts.groupBy(new_id, order).agg(
        F.min("page").alias("lo"), F.max("page").alias("hi"))
    before = Window.partitionBy(new_id).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ext = ext.withColumn("shift", F.coalesce(
        F.sum(F.col("hi") - F.col("lo") + 1).over(before), F.lit(0)) - F.col("lo") + 1)
    return (
        parts.join(ext.select(new_id, order, "shift"), [new_id, order])
        .withColumn("page", F.col("page") + F.col("shift"))
        .groupBy(new_id, "page", "token").agg(F.sum("count").alias("count"))
    )
