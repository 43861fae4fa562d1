"""Alignment: scores and runs over the strong cells of a similarity matrix.

Only cells above the threshold can carry a score, so the kernels work on those cells alone. Scores are computed in tiles, one
diagonal of tiles after the other for all pairs at once; a tile hands its last row, last column and corner on to its
neighbours. The greedy extraction of runs is sequential inside one pair; pairs are the parallel axis.
"""

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.operators.ranks import running_total
from textkin.session import cut

#: Rows and columns of a tile of the score matrix.
TILE = 256


def _tile_scores(threshold):
    """Scores of one tile's cells, given those of the cells beside it."""

    def run(cells: pa.Table, beside: pa.Table) -> pa.Table:
        score = dict(zip(zip(beside["i"].to_pylist(), beside["j"].to_pylist()), beside["score"].to_pylist()))
        cells = cells.sort_by([("i", "ascending"), ("j", "ascending")])
        out = []
        for i, j, sim in zip(*[cells[c].to_pylist() for c in ("i", "j", "sim")]):
            best = max(score.get((i - 1, j), 0.0), score.get((i, j - 1), 0.0), score.get((i - 1, j - 1), 0.0))
            score[i, j] = sim - threshold + best
            out.append(score[i, j])
        return cells.select(["left", "right", "i", "j"]).append_column("score", pa.array(out, pa.float64()))

    return run


def score_cells(cells: DataFrame, threshold=0.05, tile=TILE) -> DataFrame:
    """Local-alignment scores ``(left, right, left_seq, right_seq, score)`` of all cells above ``threshold``; other cells score 0.

    A cell adds its similarity less the threshold to the best score above it, left of it or diagonally before it. Null and NaN
    similarities are no cells. Rounds: the number of diagonals of tiles of the largest pair that has strong cells there.
    """
    strong = cells.where((F.col("sim") > float(threshold)) & ~F.isnan("sim")).select(
        "left", "right", F.col("left_seq").cast("long").alias("i"), F.col("right_seq").cast("long").alias("j"), "sim")
    strong = cut(strong.withColumns({"ti": F.floor(F.col("i") / tile), "tj": F.floor(F.col("j") / tile)}), "strong")
    keys = ["left", "right", "ti", "tj"]
    types = {f.name: f.dataType.simpleString() for f in strong.schema}
    schema = f"left {types['left']}, right {types['right']}, i long, j long, score double"
    done = []
    last = (F.col("i") % tile == tile - 1, F.col("j") % tile == tile - 1)

    def handed(found):
        """Cells at a tile's end, for the tiles below, to the right and diagonally behind."""
        at = {"ti": F.floor(F.col("i") / tile), "tj": F.floor(F.col("j") / tile)}
        to = F.filter(F.array(*[F.when(on, F.struct((at["ti"] + a).alias("ti"), (at["tj"] + b).alias("tj")))
                                for on, a, b in ((last[0], 1, 0), (last[1], 0, 1), (last[0] & last[1], 1, 1))]), lambda x: x.isNotNull())
        return found.where(last[0] | last[1]).select("left", "right", F.explode(to).alias("to"), "i", "j", "score").select(
            "left", "right", "to.ti", "to.tj", "i", "j", "score")

    diagonals = sorted(r[0] for r in strong.select(F.col("ti") + F.col("tj")).distinct().collect())  # one number per diagonal
    for d in diagonals:
        now = strong.where(F.col("ti") + F.col("tj") == d)
        beside = [handed(f) for k, f in done if k in (d - 1, d - 2)]
        none = strong.sparkSession.createDataFrame([], f"left {types['left']}, right {types['right']}, ti long, tj long, i long, j long, score double")
        beside = none if not beside else beside[0] if len(beside) == 1 else beside[0].unionByName(beside[1])
        # A tile without strong cells returns nothing, whatever is handed to it.
        beside = beside.where(F.col("ti") + F.col("tj") == d)
        found = now.groupBy(*keys).cogroup(beside.groupBy(*keys)).applyInArrow(_tile_scores(float(threshold)), schema)
        done.append((d, cut(found, "scores")))
    out = strong.where("false").select("left", "right", "i", "j", F.lit(0.0).alias("score"))
    for _, found in done:
        out = out.unionByName(found)
    return out.select("left", "right", F.col("i").alias("left_seq"), F.col("j").alias("right_seq"), "score")


def extract_runs(cells: dict, threshold: float):
    """Runs of ``{(row, col): sim}`` in order of extraction, as ``(peak, run)``.

    Scores grow along neighbouring cells; the best remaining score starts a run,
    which walks back to the most similar neighbour above, left or diagonal. The
    rows and columns of a run are then out of play.
    """
    score = {}
    for i, j in sorted(cells):
        best = max(score.get((i - 1, j), 0.0), score.get((i, j - 1), 0.0), score.get((i - 1, j - 1), 0.0))
        score[i, j] = cells[i, j] - threshold + best
    heap = [(-s, i, j) for (i, j), s in score.items()]
    heapq.heapify(heap)
    used_rows, used_cols = set(), set()
    while heap:
        s, i, j = heapq.heappop(heap)
        if i in used_rows or j in used_cols:
            continue
        run = [(i, j, cells[i, j])]
        while True:
            options = [(a, b) for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1))
                       if (a, b) in cells and a not in used_rows and b not in used_cols]
            if not options:
                break
            i, j = max(options, key=cells.__getitem__)
            run.append((i, j, cells[i, j]))
        used_rows.update(c[0] for c in run)
        used_cols.update(c[1] for c in run)
        yield -s, run


RUN_FIELDS = "k:array<long>,l:array<long>,r:array<long>,s:array<double>"


def _aligner(min_length, min_strength):
    """Runs of many pairs per call: one entry per cell of a kept run."""
    names = ["k", "l", "r", "s"]

    def one(threshold, left, right, sim):
        cells = dict(zip(zip(left.tolist(), right.tolist()), sim.tolist()))
        rows = []
        for k, (_, run) in enumerate(extract_runs(cells, threshold)):
            if len(run) > min_length and sum(c[2] for c in run) > min_strength:
                rows.extend((k, *c) for c in run)
        return [list(c) for c in zip(*rows)] or [[]] * len(names)

    @F.pandas_udf(f"struct<{RUN_FIELDS}>")
    def align(threshold: pd.Series, left: pd.Series, right: pd.Series, sim: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(threshold, left, right, sim)], columns=names)

    return align


def threshold_runs(cells: DataFrame, thresholds, min_length=3, min_strength=0.0) -> DataFrame:
    """``alignment_runs`` at several thresholds in one pass over the cells: ``(threshold, left, right, run_num, ...)``.

    The extraction is sequential inside a pair, so the strong cells of a pair are one row; they are at most the product
    of the two volumes' numbers of pages.
    """
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    strong = cells.where(F.col("sim") > float(min(thresholds))).select(
        "left", "right", F.col("left_seq").cast("long").alias("left_seq"), F.col("right_seq").cast("long").alias("right_seq"), "sim",
        F.explode(F.filter(levels, lambda t: F.col("sim") > t)).alias("threshold"))
    packed = strong.groupBy("left", "right", "threshold").agg(F.collect_list(F.struct("left_seq", "right_seq", "sim")).alias("c"))
    found = packed.select("threshold", "left", "right", _aligner(min_length, min_strength)(
        "threshold", "c.left_seq", "c.right_seq", "c.sim").alias("f"))
    runs = found.select("threshold", "left", "right", F.explode(F.arrays_zip(
        *[F.col("f." + c).alias(c) for c in ("k", "l", "r", "s")])).alias("x"))
    return runs.select("threshold", "left", "right", F.col("x.k").alias("run_num"), F.col("x.l").alias("left_seq"),
                       F.col("x.r").alias("right_seq"), F.col("x.s").alias("sim"))


def alignment_runs(cells: DataFrame, threshold=0.05, min_length=3, min_strength=0.0) -> DataFrame:
    """Runs with more than ``min_length`` cells and total similarity above ``min_strength``.

    ``cells`` is ``(left, right, left_seq, right_seq, sim)``. Output rows carry
    ``run_num``, which counts all runs of the pair in order of extraction, kept or not.
    """
    return threshold_runs(cells, [threshold], min_length, min_strength).drop("threshold")


def run_lengths(pairs: DataFrame, cells: DataFrame, thresholds) -> DataFrame:
    """Aligned cells per pair at several thresholds, one column each."""
    found = threshold_runs(cells, thresholds)
    named = {t: f"sw_{round(1000 - t * 1000):04d}_len" for t in thresholds}
    counts = found.groupBy("left", "right").agg(*[
        F.count_if(F.col("threshold") == float(t)).alias(n) for t, n in named.items()])
    out = pairs.select("left", "right").distinct().join(counts, ["left", "right"], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in named.values()})


def run_statistics(runs: DataFrame, cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Offsets, similarities and coverage of each pair's runs.

    ``sim_beside_runs`` averages the cell one column before each run cell and
    leaves out runs at the first column. Coverage is per distinct page.
    """
    off = F.abs(F.col("left_seq") - F.col("right_seq"))
    beside = cells.select("left", "right", "left_seq", (F.col("right_seq") + 1).alias("right_seq"), F.col("sim").alias("b"))
    joined = runs.join(beside, ["left", "right", "left_seq", "right_seq"], "left").withColumn(
        "beside", F.when(F.col("right_seq") > 0, F.coalesce("b", F.lit(0.0))))
    s = joined.groupBy("left", "right").agg(
        F.avg(off).alias("mean_page_diff"), F.stddev_samp(off).alias("sd_page_diff"),
        F.avg("sim").alias("sim_inside_runs"), F.avg("beside").alias("sim_beside_runs"),
        F.count_distinct("right_seq").alias("nr_in"), F.count_distinct("left_seq").alias("nl_in"))
    return (
        s.join(sizes.toDF("left", "nl"), "left").join(sizes.toDF("right", "nr"), "right")
        .withColumn("share_l_in_r", F.col("nr_in") / F.col("nr"))
        .withColumn("share_r_in_l", F.col("nl_in") / F.col("nl"))
        .drop("nr_in", "nl_in", "nl", "nr")
    )


def run_slopes(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Overall fit of right on left page, and page and word slopes within runs.

    ``pages`` is ``(htid, idx, n_tokens)``.
    """
    running = running_total(pages, ["htid"], "idx", "n_tokens", "words")
    lw = running.select(F.col("htid").alias("left"), F.col("idx").alias("left_seq"), F.col("words").alias("left_words"))
    rw = running.select(F.col("htid").alias("right"), F.col("idx").alias("right_seq"), F.col("words").alias("right_words"))
    overall = runs.groupBy("left", "right").agg(
        F.regr_slope("right_seq", "left_seq").alias("overall_slope"),
        F.regr_r2("right_seq", "left_seq").alias("strength_of_overall_fit"))

    def span(c):
        return (F.max(c) - F.min(c)).cast("double")

    per = runs.join(lw, ["left", "left_seq"]).join(rw, ["right", "right_seq"]).groupBy("left", "right", "run_num").agg(
        span("left_seq").alias("lp"), span("right_seq").alias("rp"),
        span("left_words").alias("lw"), span("right_words").alias("rw"))
    out = []
    for kind, l, r in (("page", "lp", "rp"), ("word", "lw", "rw")):
        slope, weight = F.try_divide(F.col(l), F.col(r)), (F.col(l) + F.col(r)) / 2
        out += [F.avg(slope).alias(f"in_run_{kind}_slope"),
                F.try_divide(F.sum(slope * weight), F.sum(F.when(slope.isNotNull(), weight))).alias(f"weighted_in_run_{kind}_slope")]
    return overall.join(per.groupBy("left", "right").agg(*out), ["left", "right"])
