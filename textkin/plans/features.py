"""Pair list to feature table: matrices, mean vectors and statistics in one job."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.operators import align, compare
from textkin.operators.members import with_sides
from textkin.session import cut


def pair_statistics(pairs: DataFrame, chunks: DataFrame, run_thresholds=compare.RUN_THRESHOLDS,
                    distance_thresholds=compare.DISTANCE_THRESHOLDS, quantiles=True, others: dict = None) -> DataFrame:
    """One wide row of statistics per pair.

    ``others``: further kinds of chunk vectors by name; their quantiles get the name as prefix (``srp_l_quantile_0``).
    Alignment needs only cells above the lowest threshold, so just those are
    kept; they are written once and read for every threshold.
    """
    strong = compare.similarity_cells(pairs, chunks).where(F.col("sim") > min(run_thresholds))
    parts = [align.run_lengths(pairs, cut(strong, "cells"), run_thresholds),
             compare.matrix_stats(pairs, chunks, distance_thresholds)]
    if quantiles:
        parts.append(compare.margin_quantiles(pairs, chunks))
    for name, vectors in (others or {}).items():
        parts.append(compare.margin_quantiles(pairs, vectors, prefix=name + "_"))
    return compare.join_stats(parts)


def feature_table(pairs: DataFrame, chunks: DataFrame, save_sim=True, save_wem=True, save_stats=False,
                  matrix_size=100, wem_form="concat") -> DataFrame:
    """Features of every pair in a judged list ``(left, right[, judgment, notes])``.

    Training and inference call this same function.
    """
    out = pairs.join(pair_statistics(pairs, chunks), ["left", "right"]) if save_stats else pairs
    stats = [c for c in out.columns if c not in pairs.columns]
    kinds = [compare.matrix_sides(chunks, matrix_size)] * save_sim + [compare.mean_sides(chunks)] * save_wem
    if not kinds:
        return out
    met = with_sides(out, reduce(lambda a, b: a.join(b, "htid"), kinds), compare.unrolled(matrix_size) if save_sim else None)
    return met.select(*pairs.columns, *["sim_x"] * save_sim, *[compare.mean_feature(wem_form)] * save_wem, *stats)
