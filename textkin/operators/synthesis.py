"""Synthetic training volumes: pools, choices, assembly and their ground truth."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textkin.functions.ids import content_id, page_range, shuffle_key
from textkin.functions.text import volume_number
from textkin.operators.tokens import renumber, split_parts
from textkin.operators.vectorize import title_vectors, weighted_quantiles

# ---- fixed values -------------------------------------------------------
MAX_PAGES = 742
MAX_BOOKS = 5
MIN_TITLE_DISTANCE = 0.2
POOL_QUANTILE = 0.4
TITLE_PREFIX = {"anthology": "Fake Anthology: ", "multivol": "Fake Combined Vol: "}
TITLE_LENGTH = 40
# -------------------------------------------------------------------------


def groups_having(df: DataFrame, keys, condition) -> DataFrame:
    """Rows of the groups whose aggregate satisfies ``condition``."""
    kept = df.groupBy(*keys).agg(condition.alias("_ok")).where("_ok").select(*keys)
    return df.join(kept, list(keys), "left_semi")


def quantile_below(df: DataFrame, col: str, q: float) -> DataFrame:
    """Rows under a quantile of a column (a scalar subquery)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("x")).agg(F.count("*").alias("c"))
    cut_at = weighted_quantiles(counts, [], "x", "c", [q]).select("value").scalar()
    return df.where(F.col(col) < cut_at)


def short_book_pool(meta: DataFrame, q=POOL_QUANTILE, min_titles=3) -> DataFrame:
    """Shorter books by authors with several titles; one volume per author and title."""
    short = quantile_below(meta, "page_count", q)
    rest = [c for c in short.columns if c not in ("author", "title", "htid")]
    one = short.groupBy("author", "title").agg(F.min(F.struct("htid", *rest)).alias("r")).select(
        "r.htid", "author", "title", *[f"r.{c}" for c in rest])
    return groups_having(one, ["author"], F.count("title") >= min_titles)


def consecutive_groups(meta: DataFrame) -> DataFrame:
    """Volumes of author-title groups holding two consecutive volume numbers."""
    v = meta.withColumn("descint", volume_number(F.col("description"))).where("descint IS NOT NULL")
    n = v.select("author", "title", "descint").distinct()
    after = n.withColumn("descint", F.col("descint") - 1)
    hit = n.join(after, ["author", "title", "descint"], "left_semi").select("author", "title").distinct()
    return v.join(hit, ["author", "title"], "left_semi")


def volume_islands(numbered: DataFrame, max_len=MAX_PAGES, seed=1234) -> DataFrame:
    """Runs of consecutive volume numbers, one copy per number, under a page cap.

    ``numbered`` is ``(htid, author, title, descint, page_count)``. A number's
    copy is its first in shuffled order. Numbers of a group are distinct small
    integers (at most two digits), so a group's window is bounded.
    """
    pick = numbered.groupBy("author", "title", "descint").agg(
        F.min(F.struct(shuffle_key(F.col("htid"), seed=seed).alias("k"), "htid", "page_count")).alias("p"))
    w = Window.partitionBy("author", "title").orderBy("descint")
    isl = pick.select("author", "title", "descint", "p.htid", "p.page_count").withColumn(
        "island", F.col("descint") - F.row_number().over(w))
    run = Window.partitionBy("author", "title", "island").orderBy("descint").rowsBetween(Window.unboundedPreceding, 0)
    kept = isl.withColumn("pages", F.sum("page_count").over(run)).where(F.col("pages") < max_len)
    whole = Window.partitionBy("author", "title", "island")
    return (
        kept.withColumn("size", F.count("*").over(whole)).where("size > 1")
        .withColumn("part_no", F.row_number().over(Window.partitionBy("author", "title", "island").orderBy("descint")))
        .select("author", "title", "island", "part_no", "descint", "htid", "page_count", "pages")
    )


def anthology_choices(pool: DataFrame, anthologies=2, max_len=MAX_PAGES, max_books=MAX_BOOKS,
                      min_distance=MIN_TITLE_DISTANCE, seed=1234, dims=50) -> DataFrame:
    """Members of synthetic anthologies: per author and draw, up to five unlike titles.

    The first book of the shuffled order seeds an anthology. Each step offers the
    author's books still allowed and takes the first by the step's own shuffle;
    a book over the page cap is skipped, as a draw without effect. Books too
    close in title to a chosen one leave the offer. A step is one aggregation
    over all authors, so a prolific author is never gathered.
    """
    vec = title_vectors(pool, dims).select("htid", "vec")
    books = pool.select("author", "htid", "page_count").join(vec, "htid")
    draws = books.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(anthologies))))

    def first(df, step):
        key = shuffle_key(F.col("draw"), F.lit(step), F.col("htid"), seed=seed)
        return df.groupBy("author", "draw").agg(
            F.min(F.struct(key.alias("k"), "htid", "page_count", "vec")).alias("p")).select(
            "author", "draw", "p.htid", "p.page_count", "p.vec")

    from textkin.functions.vectors import cosine
    from textkin.session import cut

    chosen = cut(first(draws, 0), "chosen")
    members = [chosen.withColumn("part_no", F.lit(1))]
    pages = chosen.select("author", "draw", F.col("page_count").cast("long").alias("pages"))
    last, offer = chosen, draws
    for step in range(1, max_books):
        near = last.select("author", "draw", F.col("vec").alias("lv"))
        offer = cut(
            offer.join(near, ["author", "draw"], "left")
            .where(F.col("lv").isNull() | (1 - cosine(F.col("vec"), F.col("lv")) > min_distance)).drop("lv"), "offer")
        drawn = first(offer, step).join(pages, ["author", "draw"])
        last = cut(drawn.where(F.col("pages") + F.col("page_count") <= max_len), "chosen")
        members.append(last.drop("pages").withColumn("part_no", F.lit(step + 1)))
        pages = cut(pages.join(last.select("author", "draw", F.col("page_count").alias("more")), ["author", "draw"], "left")
                    .select("author", "draw", (F.col("pages") + F.coalesce("more", F.lit(0))).alias("pages")), "pages")
        last = last.drop("pages")
    out = reduce(lambda a, b: a.unionByName(b), [m.select("author", "draw", "part_no", "htid", "page_count") for m in members])
    return groups_having(out, ["author", "draw"], F.count("*") > 1)


def merge_metadata(parts: DataFrame, meta: DataFrame, style="anthology") -> DataFrame:
    """One metadata row per synthetic volume from ``(new_id, part_no, htid)``.

    A synthetic volume has a handful of parts by construction.
    """
    j = parts.join(meta, "htid")
    ordered = F.sort_array(F.collect_list(F.struct("part_no", "htid", "title")))
    g = j.groupBy("new_id").agg(
        F.array_join(F.sort_array(F.collect_set("author")), "; ").alias("names"),
        F.round(F.avg("rights_date_used") + 1e-10, 6).alias("pub_date"), ordered.alias("o"),
        F.sum("page_count").alias("page_count"))
    title = F.concat(F.lit(TITLE_PREFIX[style]), F.array_join(F.transform("o", lambda s, i: F.concat(
        i.cast("string"), F.lit(") "), F.substring(s["title"], 1, TITLE_LENGTH), F.lit("..."))), ""))
    return g.select("new_id", "names", "pub_date", title.alias("title"),
                    F.array_join("o.htid", ",").alias("source_htids"), "page_count",
                    content_id(F.col("o.htid")).alias("fake_id"))


def assemble(parts: DataFrame, tokens: DataFrame, max_start=10, max_end=10, seed=1234) -> DataFrame:
    """Token lists of synthetic volumes: first front matter, all centres, first back matter.

    ``parts`` is ``(new_id, part_no, htid)``. All volumes are built together.
    """
    split = parts.join(split_parts(tokens, max_start, max_end, seed), "htid").drop("front_end", "back_start")
    first = parts.groupBy("new_id").agg(F.min("part_no").alias("first"), F.max("part_no").alias("last"))
    s = split.join(first, "new_id")
    placed = s.where((F.col("part") == "center") | (F.col("part_no") == F.col("first"))).withColumn(
        "part_no",
        F.when(F.col("part") == "front", F.col("first") - 1)
        .when(F.col("part") == "back", F.col("last") + 1).otherwise(F.col("part_no")))
    return renumber(placed.select("new_id", "part_no", "page", "token", "count"))


def source_notes(parts: DataFrame, tokens: DataFrame, **cut) -> DataFrame:
    """Page range each source contributes, by section."""
    split = split_parts(tokens, **cut)
    r = split.groupBy("htid", "part").agg(page_range(F.min("page"), F.max("page")).alias("pages"))
    return parts.join(r, "htid")


def contains_truth(parts: DataFrame, notes="fake anthology") -> DataFrame:
    """CONTAINS and PARTOF rows for every source of every synthetic volume."""
    both = F.array(
        F.struct(F.col("new_id").alias("left"), F.col("htid").alias("right"), F.lit("CONTAINS").alias("judgment")),
        F.struct(F.col("htid").alias("left"), F.col("new_id").alias("right"), F.lit("PARTOF").alias("judgment")))
    return parts.select(F.explode(both).alias("x")).select("x.*", F.lit(notes).alias("notes"))


def overlap_truth(parts: DataFrame, notes="fake overlap") -> DataFrame:
    """OVERLAPS both ways for two anthologies of one author sharing one or two sources.

    ``parts`` carries ``(author, draw, new_id, htid)`` with draws 1 and 2.
    """
    a = parts.where("draw = 1").select("author", "htid", F.col("new_id").alias("a"))
    b = parts.where("draw = 2").select("author", "htid", F.col("new_id").alias("b"))
    shared = a.join(b, ["author", "htid"]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n <= 2")
    both = F.array(F.struct(F.col("a").alias("left"), F.col("b").alias("right")),
                   F.struct(F.col("b").alias("left"), F.col("a").alias("right")))
    return shared.select(F.explode(both).alias("x")).select(
        "x.*", F.lit("OVERLAPS").alias("judgment"), F.lit(notes).alias("notes"))
