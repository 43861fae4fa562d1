"""Pairwise comparison of volumes, for all pairs at once.

Input is a pair table ``(left, right)`` plus chunk vectors ``(htid, seq, vec)``
or token lists. Chunks are packed into blocks of 64 and pairs are joined with
blocks, so a shuffle moves vectors instead of matrix cells and one row of the
kernel holds two blocks, whatever the size of the volumes. Summaries are made
from block margins without writing the matrix out.
"""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.functions import vectors as vx
from textkin.operators.members import with_sides
from textkin.operators.ranks import positions, running_total, top_per_group
from textkin.operators.tokens import page_totals
from textkin.operators.vectorize import mean_vectors, median_vectors, weighted_quantiles

BLOCK = 64
#: Pages of a block of page sets, and columns of a 0/1 matrix of tokens that one product takes.
PAGE_BLOCK, TOKEN_COLUMNS = 256, 16384
#: Bytes of the unrolled matrices that leave a task's worker at a time.
MATRIX_BYTES = 4 << 20

# ---- fixed values -------------------------------------------------------
DISTANCE_THRESHOLDS = [0.002, 0.005, 0.01, 0.02, 0.03]
RUN_THRESHOLDS = [0.990, 0.995, 0.996, 0.999]
QUANTILES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
LOG_SHIFT = 1e-7
DROP_COMMON = 200
# -------------------------------------------------------------------------


def vector_blocks(chunks: DataFrame) -> DataFrame:
    """Up to 64 consecutive chunks of a volume per row."""
    packed = chunks.groupBy("htid", F.floor((F.col("seq") - 1) / BLOCK).alias("blk")).agg(
        F.sort_array(F.collect_list(F.struct("seq", F.col("vec").cast("array<float>").alias("vec")))).alias("c"))
    return packed.select("htid", "blk", F.col("c.seq").alias("seqs"), F.flatten("c.vec").alias("flat"))


def pair_blocks(pairs: DataFrame, chunks: DataFrame, right_chunks: DataFrame = None) -> DataFrame:
    """Every pair with every combination of its sides' blocks."""
    lb = vector_blocks(chunks)
    rb = lb if right_chunks is None else vector_blocks(right_chunks)
    left = lb.select(F.col("htid").alias("left"), F.col("blk").alias("lblk"),
                     F.col("seqs").alias("lseqs"), F.col("flat").alias("lflat"))
    right = rb.select(F.col("htid").alias("right"), F.col("blk").alias("rblk"),
                      F.col("seqs").alias("rseqs"), F.col("flat").alias("rflat"))
    return pairs.select("left", "right").distinct().join(left, "left").join(right, "right")


def _block_matrix(lflat, nl, rflat, nr, center, metric):
    a = np.asarray(lflat, dtype=np.float64).reshape(nl, -1)
    b = np.asarray(rflat, dtype=np.float64).reshape(nr, -1)
    if center is not None:
        a, b = a - np.asarray(center), b - np.asarray(center)
    if metric == "dot":
        return a @ b.T
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - (a @ b.T) / np.outer(na, nb)


def _cells_udf(metric, centred):
    def flat(l, nl, r, nr, c):
        return _block_matrix(l, nl, r, nr, c, metric).ravel()

    if centred:
        @F.pandas_udf("array<double>")
        def cells(l: pd.Series, nl: pd.Series, r: pd.Series, nr: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series([flat(*x) for x in zip(l, nl, r, nr, c)])
    else:
        @F.pandas_udf("array<double>")
        def cells(l: pd.Series, nl: pd.Series, r: pd.Series, nr: pd.Series) -> pd.Series:
            return pd.Series([flat(*x, None) for x in zip(l, nl, r, nr)])
    return cells


def _cells(blocks: DataFrame, metric="cosine", center=None) -> DataFrame:
    args = ["lflat", F.size("lseqs"), "rflat", F.size("rseqs")] + ([center] if center else [])
    return (
        blocks.withColumn("v", _cells_udf(metric, center is not None)(*args))
        .select("left", "right", "lseqs", "rseqs", F.posexplode("v").alias("i", "value"))
        .select("left", "right",
                F.element_at("lseqs", (F.floor(F.col("i") / F.size("rseqs")) + 1).cast("int")).alias("left_seq"),
                F.element_at("rseqs", (F.col("i") % F.size("rseqs") + 1).cast("int")).alias("right_seq"),
                "value")
    )


def distance_cells(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cosine distance of every chunk pair of every volume pair."""
    return _cells(pair_blocks(pairs, chunks)).withColumnRenamed("value", "dist")


def similarity_cells(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    return distance_cells(pairs, chunks).select(
        "left", "right", "left_seq", "right_seq", (F.lit(1.0) - F.col("dist")).alias("sim"))


def recentred_cells(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cosine distances after subtracting the mean of the two volumes' mean vectors."""
    m = mean_vectors(chunks)
    blocks = (
        pair_blocks(pairs, chunks)
        .join(m.select(F.col("htid").alias("left"), F.col("vec").alias("lm")), "left")
        .join(m.select(F.col("htid").alias("right"), F.col("vec").alias("rm")), "right")
        .withColumn("center", vx.mean_of(F.col("lm"), F.col("rm")))
    )
    return _cells(blocks, center="center").withColumnRenamed("value", "dist")


def median_centred_dots(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Dot products after subtracting the component-wise median of both volumes' chunks."""
    p = pairs.select("left", "right").distinct()
    members = p.select("left", "right", F.explode(F.array("left", "right")).alias("htid"))
    medians = median_vectors(members.join(chunks, "htid"), ["left", "right"])
    blocks = pair_blocks(p, chunks).join(
        medians.withColumnRenamed("vec", "center"), ["left", "right"])
    return _cells(blocks, "dot", center="center").withColumnRenamed("value", "sim")


def paired_similarities(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dot products between the chunks of two id sets, for the volume pairs asked for."""
    return _cells(pair_blocks(pairs, left, right), "dot").withColumnRenamed("value", "sim")


def unrolled_matrix(pairs: DataFrame, chunks: DataFrame, max_size=50) -> DataFrame:
    """Similarity matrix cut or zero-padded to ``max_size`` squared, row by row.

    Chunks beyond the size are dropped before any shuffle, so a side is at most
    ``max_size`` vectors.
    """
    return with_unrolled_matrix(pairs.select("left", "right").distinct(), chunks, max_size)


def with_unrolled_matrix(pairs: DataFrame, chunks: DataFrame, max_size=50) -> DataFrame:
    """``pairs`` with all their columns and ``sim_x``, made after the joins: matrices are wide and never take part in one."""
    return with_sides(pairs, matrix_sides(chunks, max_size), unrolled(max_size))


def matrix_sides(chunks: DataFrame, max_size: int) -> DataFrame:
    """``(htid, seqs, flat)``: the chunks of a volume that a matrix of ``max_size`` takes."""
    side = chunks.where(F.col("seq") <= max_size).groupBy("htid").agg(
        F.sort_array(F.collect_list(F.struct("seq", F.col("vec").cast("array<float>").alias("vec")))).alias("c"))
    return side.select("htid", F.col("c.seq").alias("seqs"), F.flatten("c.vec").alias("flat"))


def unrolled(max_size: int):
    """``sim_x`` of pairs that meet their ``matrix_sides``."""
    return _unrolled(max_size), ("seqs", "flat"), "sim_x", "array<float>"


def _unrolled(max_size: int):
    """Matrices of rows with two sides, sent on a few at a time: a batch of narrow rows would give gigabytes of them."""
    rows, size, uses = max(1, MATRIX_BYTES // (4 * max_size * max_size)), max_size * max_size, ("l_flat", "l_seqs", "r_flat", "r_seqs")

    def unroll(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                full = np.zeros((part.num_rows, max_size, max_size), dtype=np.float32)
                for out, lf, lq, rf, rq in zip(full, *[[x.values.to_numpy(zero_copy_only=False) for x in part[c]] for c in uses]):
                    sim = 1.0 - _block_matrix(lf, len(lq), rf, len(rq), None, "cosine")
                    out[np.ix_(lq - 1, rq - 1)] = np.nan_to_num(sim)
                sims = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * size, pa.array(full.ravel()))
                keep = [c for c in part.schema.names if c not in uses]
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, sims], [*keep, "sim_x"])

    return unroll


def unrolled_cells(pairs: DataFrame, cells: DataFrame, max_size=50) -> DataFrame:
    """``unrolled_matrix`` from cells ``(left, right, left_seq, right_seq, sim)`` numbered from 0, such as page Jaccard cells.

    Cells that are not listed are 0; those beyond the size are dropped before the shuffle.
    """
    near = cells.where((F.col("left_seq") < max_size) & (F.col("right_seq") < max_size))
    at = (F.col("left_seq") * max_size + F.col("right_seq")).cast("int")
    listed = near.groupBy("left", "right").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("i"), F.col("sim").cast("float").alias("x")))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(max_size * max_size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0).cast("float")))
    return pairs.select("left", "right").distinct().join(listed, ["left", "right"], "left").select("left", "right", full.alias("sim_x"))


def cells_where(cells: DataFrame, predicate) -> DataFrame:
    """Cells whose value satisfies ``predicate(column)``; the value is the column ``dist`` or ``sim``."""
    return cells.where(predicate(F.col("dist" if "dist" in cells.columns else "sim")))


# ---- summaries of the distance matrix -------------------------------------

def margins(pairs: DataFrame, chunks: DataFrame):
    """Row and column minima, and matrix totals, from block summaries.

    Returns ``(minima, totals)``: ``(left, right, side, seq, dist)`` with side L
    for rows and R for columns, and ``(left, right, total, cells)``.
    """
    @F.pandas_udf("struct<rows:array<double>,cols:array<double>,total:double,cells:long>")
    def summarise(l: pd.Series, nl: pd.Series, r: pd.Series, nr: pd.Series) -> pd.DataFrame:
        out = []
        for a, n, b, m in zip(l, nl, r, nr):
            d = _block_matrix(a, n, b, m, None, "cosine")
            out.append((d.min(axis=1), d.min(axis=0), d.sum(), d.size))
        return pd.DataFrame(out, columns=["rows", "cols", "total", "cells"])

    s = pair_blocks(pairs, chunks).select(
        "left", "right", "lblk", "rblk", "lseqs", "rseqs",
        summarise("lflat", F.size("lseqs"), "rflat", F.size("rseqs")).alias("s"))
    sides = F.array(
        F.struct(F.lit("L").alias("side"), F.arrays_zip(F.col("lseqs").alias("seq"), F.col("s.rows").alias("d")).alias("m")),
        F.struct(F.lit("R").alias("side"), F.arrays_zip(F.col("rseqs").alias("seq"), F.col("s.cols").alias("d")).alias("m")))
    minima = (
        s.select("left", "right", F.explode(sides).alias("x"))
        .select("left", "right", "x.side", F.explode("x.m").alias("m"))
        .groupBy("left", "right", "side", F.col("m.seq").alias("seq")).agg(F.min("m.d").alias("dist"))
    )
    totals = s.groupBy("left", "right").agg(F.sum("s.total").alias("total"), F.sum("s.cells").alias("cells"))
    return minima, totals


def threshold_name(t: float) -> str:
    return f"{round(t * 1000):04d}"


def matrix_stats(pairs: DataFrame, chunks: DataFrame, thresholds=DISTANCE_THRESHOLDS) -> DataFrame:
    """Sizes, mean distance, mean and truncated minima, shares under thresholds."""
    minima, totals = margins(pairs, chunks)
    shares = [F.avg((F.col("dist") < t).cast("double")).alias("prop_dist_" + threshold_name(t)) for t in thresholds]
    per = minima.groupBy("left", "right", "side").agg(
        F.count("*").alias("size"), F.avg("dist").alias("mean_min_dist"), F.sort_array(F.collect_list("dist")).alias("minima"), *shares)
    size = per.groupBy("left", "right").agg(F.min("size").alias("min_size"))
    # A side has one minimum per chunk of a volume: few enough to sort in one row.
    least = F.slice("minima", F.lit(1), F.col("min_size").cast("int"))
    per = per.join(size, ["left", "right"]).withColumn(
        "trunc_dist", F.aggregate(least, F.lit(0.0), lambda s, x: s + x) / F.col("min_size"))
    names = ["size", "mean_min_dist", "trunc_dist"] + ["prop_dist_" + threshold_name(t) for t in thresholds]
    wide = per.groupBy("left", "right").agg(*[
        F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{s.lower()}_{n}") for s in ("L", "R") for n in names])
    return wide.join(totals.select("left", "right", (F.col("total") / F.col("cells")).alias("mean_dist")),
                     ["left", "right"]).withColumn("min_size", F.least("l_size", "r_size"))


def margin_quantiles(pairs: DataFrame, chunks: DataFrame, quantiles=QUANTILES, prefix="") -> DataFrame:
    """Quantiles of row and column minima: one column per side and quantile, named after ``prefix``."""
    minima, _ = margins(pairs, chunks)
    q = minima.groupBy("left", "right", "side").agg(F.percentile("dist", F.array(*[F.lit(float(v)) for v in quantiles])).alias("q"))
    return q.groupBy("left", "right").agg(*[
        F.max(F.when(F.col("side") == s, F.col("q")[i])).alias(f"{prefix}{s.lower()}_quantile_{round(v * 10):d}")
        for s in ("L", "R") for i, v in enumerate(quantiles)])


def page_count_stats(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    m = meta.select("htid", "page_count")
    l, r = F.col("left_page_count"), F.col("right_page_count")
    return (
        pairs.select("left", "right")
        .join(m.toDF("left", "left_page_count"), "left").join(m.toDF("right", "right_page_count"), "right")
        .select("left", "right", l, r, (l - r).alias("page_diff"),
                F.try_divide((l - r).cast("double"), l).alias("page_prop_diff"))
    )


def mean_vector_features(pairs: DataFrame, chunks: DataFrame, form="mean_diff") -> DataFrame:
    """Book-level features: mean and difference of mean vectors, or their concatenation."""
    met = with_sides(pairs.select("left", "right").distinct(), mean_sides(chunks))
    return met.select("left", "right", mean_feature(form))


def mean_sides(chunks: DataFrame) -> DataFrame:
    """``(htid, mean)``: the mean vector of every volume."""
    return mean_vectors(chunks).select("htid", F.col("vec").alias("mean"))


def mean_feature(form: str):
    """``wem_x`` of a pair that met its ``mean_sides``."""
    l, r = F.col("l_mean"), F.col("r_mean")
    parts = (vx.mean_of(l, r), vx.difference(l, r)) if form == "mean_diff" else (l, r)
    return F.concat(*parts).alias("wem_x")


def derived_stats(stats: DataFrame) -> DataFrame:
    """Shares and log transforms that replace the raw statistics."""
    run_cols = [c for c in stats.columns if c.startswith("sw_") and c.endswith("_len")]
    logged = [c for c in stats.columns if c.endswith(("mean_dist", "min_dist", "trunc_dist")) or "quantile" in c]
    new = {}
    for c in run_cols:
        for s in ("l", "r"):
            new[f"{s}_{c[:-4]}_prop"] = F.col(c) / F.col(f"{s}_size")
    for c in logged:
        new[c + "_log"] = F.ln(F.col(c) + LOG_SHIFT)
    new["prop_size"] = F.col("l_size") / F.col("r_size")
    return stats.withColumns(new).drop("l_size", "r_size", "min_size", *run_cols, *logged)


def outlier_slice(pairs: DataFrame, low_col, low_q, high_col, high_q, size_col, min_size=4) -> DataFrame:
    """Pairs below one statistic's quantile and above another's, large enough to matter."""
    def cut_at(col, q):
        counts = pairs.groupBy(F.col(col).alias("x")).agg(F.count("*").alias("c"))
        return weighted_quantiles(counts, [], "x", "c", [q]).select("value").scalar()

    return pairs.where(
        (F.col(low_col) < cut_at(low_col, low_q)) & (F.col(high_col) > cut_at(high_col, high_q))
        & (F.col(size_col) > min_size))


# ---- page sets -------------------------------------------------------------

def page_index(tokens: DataFrame) -> DataFrame:
    """Dense 0-based index of every page that holds tokens, with its token count."""
    return positions(page_totals(tokens), ["htid"], F.floor(F.col("page") / 1024), ["page"], pos="idx")


def page_sets(tokens: DataFrame) -> DataFrame:
    """(htid, idx, token): a token list holds each token of a page once."""
    pages = page_totals(tokens).groupBy("htid").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    return tokens.select("htid", "page", "token").join(pages, "htid").select(
        "htid", (F.array_position("pages", F.col("page")) - 1).alias("idx"), "token")


def page_blocks(sets: DataFrame) -> DataFrame:
    """Token ids (64-bit hashes) of up to ``PAGE_BLOCK`` consecutive pages of a volume per row, with the page of each."""
    packed = sets.groupBy("htid", F.floor(F.col("idx") / PAGE_BLOCK).alias("blk")).agg(
        F.sort_array(F.collect_list(F.struct("idx", F.xxhash64("token").alias("id")))).alias("c"))
    return packed.select("htid", "blk", F.col("c.idx").alias("pages"), F.col("c.id").alias("ids"))


def _most_common(k):
    """Ids of the ``k`` tokens on most pages of two volumes; of equally common ones those first in order."""

    def of(left, right):
        ids, df, words = (pa.concat_arrays([x.field(n) for x in (left, right)]) for n in ("id", "df", "token"))
        own, first, at = np.unique(ids.to_numpy(), return_index=True, return_inverse=True)
        df = np.bincount(at, weights=df.to_numpy(), minlength=len(own))
        if len(own) <= k:
            return own
        least = -np.partition(-df, k - 1)[k - 1]
        more, ties = np.flatnonzero(df > least), np.flatnonzero(df == least)
        order = pc.sort_indices(pc.cast(words.take(pa.array(first[ties])), pa.binary())).to_numpy()
        return own[np.concatenate([more, ties[order[:k - len(more)]]])]

    def run(batches):
        for batch in batches:
            found = [of(l.values, r.values) for l, r in zip(batch["l"], batch["r"])]
            yield pa.RecordBatch.from_arrays([batch["left"], batch["right"], pa.array(found, pa.list_(pa.int64()))], ["left", "right", "common"])

    return run


def common_tokens(pairs: DataFrame, sets: DataFrame, drop_common: int) -> DataFrame:
    """Ids of each pair's most frequent tokens: ``(left, right, common)``.

    Pages are counted per volume first; a volume's vocabulary is one row, so no row stands for a token of a pair.
    """
    df = sets.groupBy("htid", "token").agg(F.count("*").alias("df")).groupBy("htid").agg(
        F.collect_list(F.struct(F.xxhash64("token").alias("id"), "df", "token")).alias("v"))
    met = pairs.join(df.select(F.col("htid").alias("left"), F.col("v").alias("l")), "left").join(
        df.select(F.col("htid").alias("right"), F.col("v").alias("r")), "right")
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return met.select("left", "right", "l", "r").mapInArrow(
        _most_common(drop_common), f"left {types['left']}, right {types['right']}, common array<long>")


def _page_jaccard(lpages, lids, rpages, rids, common):
    """Non-zero cells of two blocks of pages: left page, right page, similarity."""
    if len(common):
        keep = ~np.isin(lids, common)
        lpages, lids = lpages[keep], lids[keep]
        keep = ~np.isin(rids, common)
        rpages, rids = rpages[keep], rids[keep]
    shared = np.intersect1d(lids, rids)
    if not len(shared):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    sides = []
    for pages, ids in ((lpages, lids), (rpages, rids)):
        own, row, size = np.unique(pages, return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(shared, ids), len(shared) - 1)
        sides.append((own, row, size, at, shared[at] == ids))
    (lown, lrow, lsize, lat, lhit), (rown, rrow, rsize, rat, rhit) = sides
    both = np.zeros((len(lown), len(rown)))
    for low in range(0, len(shared), TOKEN_COLUMNS):
        n = min(TOKEN_COLUMNS, len(shared) - low)
        l, r = np.zeros((len(lown), n), dtype=np.float32), np.zeros((len(rown), n), dtype=np.float32)
        for m, row, at, hit in ((l, lrow, lat, lhit), (r, rrow, rat, rhit)):
            hit = hit & (at >= low) & (at < low + n)
            m[row[hit], at[hit] - low] = 1
        both += l @ r.T
    i, j = np.nonzero(both)
    inter = both[i, j]
    return lown[i], rown[j], inter / np.maximum(lsize[i] + rsize[j] - inter, 1)


def jaccard_cells(pairs: DataFrame, sets: DataFrame, drop_common=DROP_COMMON) -> DataFrame:
    """Non-zero cells of the page-by-page Jaccard matrix of every pair.

    ``sets`` is ``(htid, idx, token)``; every cell not listed is 0. ``drop_common``
    removes the tokens found on most pages of the two volumes. Pages meet in pairs of blocks, as products of 0/1 matrices over
    the tokens that both blocks hold, so no row stands for a token of two pages.
    """
    p = pairs.select("left", "right").distinct()
    blocks = page_blocks(sets)
    # The common tokens come first: they are short, while pages of both sides would be sent once more to meet them.
    p = common_tokens(p, sets, drop_common) if drop_common else p.withColumn("common", F.lit(None).cast("array<long>"))
    rows = p.join(blocks.select(F.col("htid").alias("left"), F.col("pages").alias("lpages"), F.col("ids").alias("lids")), "left")
    rows = rows.join(blocks.select(F.col("htid").alias("right"), F.col("pages").alias("rpages"), F.col("ids").alias("rids")), "right")
    types = {f.name: f.dataType.simpleString() for f in p.schema}

    def run(batches):
        def values(batch, name):
            column = batch[name]
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
            return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

        for batch in batches:
            cells = [_page_jaccard(*x) for x in zip(*[values(batch, c) for c in ("lpages", "lids", "rpages", "rids", "common")])]
            if not cells:
                continue
            row = pa.array(np.repeat(np.arange(len(cells)), [len(c[0]) for c in cells]))
            l, r, sim = (np.concatenate(x) for x in zip(*cells))
            yield pa.RecordBatch.from_arrays([batch["left"].take(row), batch["right"].take(row), pa.array(l, pa.int64()), pa.array(r, pa.int64()), pa.array(sim)],
                                             ["left", "right", "left_seq", "right_seq", "sim"])

    return rows.select("left", "right", "lpages", "lids", "rpages", "rids", "common").mapInArrow(
        run, f"left {types['left']}, right {types['right']}, left_seq long, right_seq long, sim double")


def four_points(pairs: DataFrame, cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Largest cell values read at a quarter, half, one and two lengths of the shorter side.

    ``sizes`` is ``(htid, n)``, pages per volume; cells not listed count as 0.
    """
    p = (
        pairs.select("left", "right").distinct()
        .join(sizes.toDF("left", "nl"), "left").join(sizes.toDF("right", "nr"), "right")
        .withColumn("shorter", F.least("nl", "nr"))
    )
    # Equal values are ranked as one: a value covers the ranks from upto - c to upto - 1.
    valued = cells.groupBy("left", "right", (-F.col("sim")).alias("neg")).agg(F.count("*").alias("c"))
    ranked = running_total(valued, ["left", "right"], "neg", "c", "upto", block=1 / 4096)
    points = {"sim_at_quarter_length": F.floor(F.col("shorter") / 4), "sim_at_half_length": F.floor(F.col("shorter") / 2),
              "sim_at_full_length": F.col("shorter"), "sim_at_double_length": F.col("shorter") * 2}

    def read(at):
        hit = (F.col("upto") - F.col("c") <= at) & (at < F.col("upto"))
        return F.coalesce(F.max(F.when(hit, -F.col("neg"))), F.lit(0.0))

    return p.join(ranked, ["left", "right"], "left").groupBy("left", "right").agg(
        *[read(at).alias(name) for name, at in points.items()])


def join_stats(parts) -> DataFrame:
    """One wide row per pair from several statistics tables."""
    return reduce(lambda a, b: a.join(b, ["left", "right"], "full"), parts)
