"""Candidate pairs: chunk matches, fuzzy titles, shared authors and rating lists."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.functions.ids import shuffle_key
from textkin.functions.text import title_prefix
from textkin.operators.knn import chunk_neighbours, knn_join, one_to_one
from textkin.operators.ranks import shuffled_positions, top_per_group
from textkin.operators.vectorize import title_vectors


def volume_extents(chunks: DataFrame) -> DataFrame:
    """Smallest and largest chunk number and chunk count per volume."""
    return chunks.groupBy("htid").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("length"))


def volume_ranges(chunks: DataFrame) -> DataFrame:
    """Contiguous integer ranges of chunk ids per volume, in id order.

    The running sum runs over one row per volume, placed by the distributed
    numbering, as a tree of block sums, so nothing is ordered in a single task.
    """
    from textkin.operators.ranks import running_total

    ext = shuffled_positions(volume_extents(chunks), [], ["htid"])
    total = running_total(ext, [], "pos", "length", "end", levels=3)
    return total.select("htid", (F.col("end") - F.col("length")).alias("min"),
                        (F.col("end") - 1).alias("max"), "length")


def range_ids(ranges: DataFrame) -> DataFrame:
    """One row per chunk id: the range join as an equi-join table."""
    return ranges.select("htid", F.explode(F.sequence("min", "max")).alias("id"), "min").select(
        "id", "htid", (F.col("id") - F.col("min") + 1).alias("seq"))


def doc_match_stats(neighbours: DataFrame, extents: DataFrame, min_count=None) -> DataFrame:
    """Chunk matches summed to volume pairs.

    ``neighbours`` is chunk kNN output. Every matched chunk counts once per
    target volume. ``min_count`` is lowered to the target's own length.
    """
    pairs = one_to_one(neighbours).groupBy("target", "match").agg(
        F.count("*").alias("count"), F.avg("dist").alias("mean"))
    t = extents.select(F.col("htid").alias("target"), F.col("length").alias("target_length"))
    m = extents.select(F.col("htid").alias("match"), "length")
    out = (
        pairs.join(t, "target").join(m, "match")
        .withColumn("prop_target", F.col("count") / F.col("target_length"))
        .withColumn("prop_match", F.col("count") / F.col("length"))
    )
    if min_count and min_count > 1:
        out = out.where(F.col("count") >= F.least(F.lit(min_count), F.col("target_length")))
    return out.select("target", "match", "count", "mean", "length", "prop_target", "prop_match")


def filter_stats(stats: DataFrame, min_count=None, max_mean=None, min_prop_match=None) -> DataFrame:
    if min_count:
        stats = stats.where(F.col("count") >= min_count)
    if max_mean is not None:
        stats = stats.where(F.col("mean") <= max_mean)
    if min_prop_match is not None:
        stats = stats.where(F.col("prop_match") >= min_prop_match)
    return stats


def strong_candidates(stats: DataFrame, prop=0.5) -> DataFrame:
    return stats.where(
        ((F.col("prop_target") > prop) | (F.col("prop_match") > prop))
        & (F.col("count") > 1) & (F.col("match") != F.col("target")))


def ann_candidates(chunks: DataFrame, targets: DataFrame = None, n=300, min_count=2, max_dist=0.25,
                   min_prop_match=None, exact=False) -> DataFrame:
    """Chunk-based candidates of all targets, the targets themselves left out.

    Chunks are found by bands of random hyperplanes; ``exact`` compares every pair instead.
    """
    wanted = chunks if targets is None else chunks.join(targets.select("htid").distinct(), "htid", "left_semi")
    nn = chunk_neighbours(wanted, chunks, n, max_dist, drop_self=False, banded=not exact)
    stats = doc_match_stats(nn, volume_extents(chunks), min_count)
    return filter_stats(stats, min_prop_match=min_prop_match).where("match <> target")


def same_author_candidates(meta: DataFrame, targets: DataFrame = None, max_results=100, seed=1234) -> DataFrame:
    """Up to ``max_results`` other volumes by the target's author.

    An author's volumes stand on a ring in pseudo-random order and each target
    takes the ones after it. The output is linear in the targets; neither the
    pairs nor the members of a prolific author are gathered.
    """
    known = meta.select("htid", "author").where(F.col("author").isNotNull() & (F.trim("author") != ""))
    ring = shuffled_positions(known, ["author"], ["htid"], seed, size="size")
    asking = ring if targets is None else ring.join(targets.select("htid").distinct(), "htid", "left_semi")
    steps = F.least(F.lit(max_results).cast("long"), F.col("size") - 1)
    wanted = asking.where("size > 1").select(
        F.col("htid").alias("target"), "author", "pos", "size", F.explode(F.sequence(F.lit(1).cast("long"), steps)).alias("step")
    ).select("target", "author", F.pmod(F.col("pos") + F.col("step"), F.col("size")).alias("pos"))
    return wanted.join(ring.select("author", "pos", F.col("htid").alias("match")), ["author", "pos"]).select(
        "match", "target", F.lit("author").alias("note"))


def title_candidates(meta: DataFrame, targets: DataFrame = None, max_dist=0.35, n=25, wider=100, widen_below=0.3,
                     dims=50, exact=False) -> DataFrame:
    """Volumes with a similar title.

    25 neighbours, or 100 where even the 25th is closer than .3; cut at
    ``max_dist``. One list per distinct title vector serves all its copies.
    """
    vecs = title_vectors(meta, dims)
    wanted = vecs if targets is None else vecs.join(targets.select("htid").distinct(), "htid", "left_semi")
    nn = knn_join(wanted, vecs, wider, keys=("htid",), max_dist=max_dist, drop_self=False, banded=not exact)
    # rank counts the volume itself, as the list of n results does
    far = nn.where((F.col("rank") == n - 1) & (F.col("dist") < widen_below)).select("t_htid", F.lit(True).alias("wide"))
    kept = nn.join(far, "t_htid", "left").where((F.col("rank") < n) | F.col("wide"))
    return kept.where(
        (F.col("dist") <= max_dist) & (F.col("t_htid") != F.col("m_htid"))
    ).select(F.col("m_htid").alias("match"), F.col("t_htid").alias("target"), F.lit("meta").alias("note"))


def meta_candidates(meta: DataFrame, targets: DataFrame = None, sim_titles=True, same_authors=True,
                    max_author_results=100, **title_options) -> DataFrame:
    """Union of title and author candidates with their note."""
    if not (sim_titles or same_authors):
        raise ValueError("choose sim_titles, same_authors or both")
    parts = []
    if same_authors:
        parts.append(same_author_candidates(meta, targets, max_author_results))
    if sim_titles:
        parts.append(title_candidates(meta, targets, **title_options))
    return reduce(lambda a, b: a.unionByName(b), parts)


def all_candidates(ann: DataFrame, meta: DataFrame) -> DataFrame:
    """Distinct pairs of both kinds; ``notes`` lists where a pair came from."""
    both = ann.select("target", "match", F.lit("ann").alias("note")).unionByName(
        meta.select("target", "match", "note"))
    return both.where("target <> match").groupBy("target", "match").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("note"))).alias("notes"))


# ---- rating lists ---------------------------------------------------------

def value_matches(meta: DataFrame, targets: DataFrame, key, rule: str, max_matches=None) -> DataFrame:
    """Volumes sharing a non-blank key value with a target.

    ``(target, match, rule)``. Without a cap the output holds every match of the
    given targets; with ``max_matches`` each target takes that many from the
    ring of its key value, as for authors.
    """
    keyed = meta.select("htid", key.alias("k")).where(F.col("k").isNotNull() & (F.trim("k") != ""))
    asking = keyed.join(targets.select("htid").distinct(), "htid", "left_semi")
    if max_matches is None:
        out = asking.select(F.col("htid").alias("target"), "k").join(
            keyed.select(F.col("htid").alias("match"), "k"), "k").where("target <> match")
    else:
        renamed = keyed.withColumnRenamed("k", "author")
        out = same_author_candidates(renamed, targets, max_matches)
    return out.select("target", "match", F.lit(rule).alias("rule"))


def rating_lists(meta: DataFrame, targets: DataFrame, near: DataFrame = None, max_by_author=5, max_random=3,
                 seed=1234) -> DataFrame:
    """Volumes to judge by hand for each target: one equi-join per rule.

    Rules: equal OCLC, LCCN or ISBN number, title, first 30 title characters,
    near title vectors (``near``: target, match), then up to five further
    volumes by the author and three random ones. ``targets`` is the sample to
    be judged, so lists stay in proportion to it.
    """
    rules = {"oclc": F.col("oclc_num"), "lccn": F.col("lccn"), "isbn": F.col("isbn"),
             "title": F.col("title"), "short_title": title_prefix(F.col("title"))}
    parts = [value_matches(meta, targets, c, r) for r, c in rules.items()]
    if near is not None:
        parts.append(near.select("target", "match", F.lit("vector").alias("rule")))
    found = reduce(lambda a, b: a.unionByName(b), parts)
    init = found.groupBy("target", "match").agg(F.min("rule").alias("rule"))
    # Authors: enough ring neighbours that max_by_author remain whatever init removes.
    author = fill_by_author(meta, targets, init, max_by_author)
    rand = random_matches(meta, targets, max_random, seed)
    return init.unionByName(author).unionByName(rand).groupBy("target", "match").agg(
        F.min("rule").alias("rule"))


def fill_by_author(meta: DataFrame, targets: DataFrame, taken: DataFrame, k: int) -> DataFrame:
    """The first ``k`` volumes, in shuffled order, of each target's author that are not taken yet.

    A target needs at most k + (its taken volumes by that author) of the author's
    list, so each author's rank list is only entered that deep.
    """
    known = meta.select("htid", "author").where(F.col("author").isNotNull() & (F.trim("author") != ""))
    asking = known.join(targets.select("htid").distinct(), "htid", "left_semi").withColumnRenamed("htid", "target")
    placed = shuffled_positions(known, ["author"], ["htid"])
    removed = (
        taken.select("target", F.col("match").alias("htid"))
        .join(placed, "htid").join(asking.withColumnRenamed("author", "own"), "target")
        .where("author = own").groupBy("target").agg(F.count("*").alias("gone"))
    )
    depth = asking.join(removed, "target", "left").withColumn(
        "pos", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("gone", F.lit(0)) + k)))
    offered = depth.select("target", "author", "pos").join(
        placed.withColumnRenamed("htid", "match"), ["author", "pos"]).where("target <> match")
    free = offered.join(taken.select("target", "match"), ["target", "match"], "left_anti")
    return top_per_group(free, ["target"], ["pos"], k).select("target", "match", F.lit("author").alias("rule"))


def random_matches(meta: DataFrame, targets: DataFrame, k: int, seed=1234) -> DataFrame:
    """``k`` pseudo-random volumes per target, all others if there are fewer.

    A target takes the volumes from a place of its own on, in one shuffled order that closes to a ring.
    """
    placed = shuffled_positions(meta.select("htid").distinct(), [], ["htid"], seed)
    total = placed.count()
    if total < 2:
        return placed.select(F.col("htid").alias("target"), F.col("htid").alias("match"), F.lit("random").alias("rule")).limit(0)
    begin = F.conv(F.substring(shuffle_key(F.col("target"), seed=seed), 1, 14), 16, 10).cast("long")
    wanted = (
        targets.select(F.col("htid").alias("target")).distinct()
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(min(k, total - 1)))))
        .select("target", "i", F.pmod(begin + F.col("i"), F.lit(total)).alias("pos"))
    )
    found = wanted.join(placed.select("pos", F.col("htid").alias("match")), "pos").where("target <> match")
    return top_per_group(found, ["target"], ["i"], k).select("target", "match", F.lit("random").alias("rule"))


def near_titles(meta: DataFrame, targets: DataFrame = None, cutoff=0.05, n=100, dims=50, exact=False) -> DataFrame:
    """Nearest titles under a cosine-distance cut-off: ``target, match, cos_dist``."""
    vecs = title_vectors(meta, dims)
    wanted = vecs if targets is None else vecs.join(targets.select("htid").distinct(), "htid", "left_semi")
    nn = knn_join(wanted, vecs, n, keys=("htid",), max_dist=(2 * cutoff) ** 0.5, banded=not exact)
    return nn.select(F.col("t_htid").alias("target"), F.col("m_htid").alias("match"),
                     (F.col("dist") * F.col("dist") / 2).alias("cos_dist")).where(F.col("cos_dist") < cutoff)


def title_distances(pairs: DataFrame, meta: DataFrame, dims=50) -> DataFrame:
    """Cosine distance of the cleaned-title vectors of given pairs ``(left, right)``."""
    from textkin.functions.text import clean_title
    from textkin.functions.vectors import cosine

    cleaned = meta.select("htid", clean_title(F.col("title")).alias("title"))
    v = title_vectors(cleaned, dims, full_weight=0.0, clean_weight=1.0).select("htid", "vec")
    return (
        pairs.select("left", "right").join(v.toDF("left", "lv"), "left").join(v.toDF("right", "rv"), "right")
        .select("left", "right", (1 - cosine(F.col("lv"), F.col("rv"))).alias("title_distance"))
    )
