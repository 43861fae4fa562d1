"""Volumes to manifestations to works: folding over falling confidence thresholds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.functions.labels import canonical
from textkin.operators.graph import communities, weighted_means
from textkin.operators.relations import high_confidence
from textkin.session import cut, remove

# ---- fixed values -------------------------------------------------------
THRESHOLDS = [0.99, 0.98, 0.97, 0.96, 0.95, 0.94, 0.93, 0.92, 0.91, 0.90, 0.89, 0.88, 0.87, 0.86,
              0.85, 0.83, 0.81, 0.79, 0.77]
MANIFESTATION_FIELDS = ["p_swsm"]
WORK_FIELDS = ["p_swsm", "p_swde"]
# -------------------------------------------------------------------------


def volumes_of(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.explode(F.array("target", "candidate")).alias("htid")).distinct()


def fold_once(pairs: DataFrame, reference: DataFrame, id_col: str, fields, threshold, method, pass_name, replaces=()):
    """One pass: cluster strong pairs, relabel the reference, fold the pairs.

    Labels exist only for ids that met a strong edge, all others keep theirs, so
    both joins are against the (small) changed part. Count-weighted means
    compose, so pairs are folded from the previous pass instead of the base.
    Returns ``None`` when no pair qualifies. ``replaces``: tables of the pass before, deleted when this one is written.
    """
    edges = cut(high_confidence(pairs, fields, threshold).select("target", "candidate"), "strong")
    if edges.isEmpty():
        remove(edges.sparkSession, edges.cut_path)
        return None
    labels = cut(communities(edges, method).where("id <> label"), "labels")
    reference = cut(
        reference.join(labels.toDF(id_col, "_new"), id_col, "left")
        .withColumn(pass_name, F.col(id_col)).withColumn(id_col, F.coalesce("_new", id_col)).drop("_new"), "reference")
    for side in ("target", "candidate"):
        pairs = pairs.join(labels.toDF(side, "_new"), side, "left").withColumn(
            side, F.coalesce("_new", side)).drop("_new")
    pairs = cut(weighted_means(canonical(pairs).drop("flipped")), "pairs", replaces=[edges, labels, *replaces])
    return pairs, reference


def fold(pairs: DataFrame, reference: DataFrame, id_col: str, fields, thresholds=THRESHOLDS, method="louvain"):
    """All passes of one level; pass columns ``<id_col>_pass<k>`` keep the earlier ids."""
    done, replaces = 0, []
    for p in thresholds:
        step = fold_once(pairs, reference, id_col, fields, p, method, f"{id_col}_pass{done}", replaces)
        if step is not None:
            pairs, reference = step
            replaces = list(step)
            done += 1
    return pairs, reference


def volumes_to_works(clean: DataFrame, thresholds=THRESHOLDS, method="louvain"):
    """Manifestation and work id of every volume, plus cluster-level predictions.

    ``clean`` holds canonical pairs with mean probabilities and ``count``.
    Returns ``(clusters, manifestation_predictions, work_predictions)``.
    """
    start = cut(clean, "clean")
    ref = cut(volumes_of(start).withColumn("man_id", F.col("htid")), "reference")
    man_pairs, ref = fold(start, ref, "man_id", MANIFESTATION_FIELDS, thresholds, method)
    ref = ref.withColumn("work_id", F.col("man_id"))
    work_pairs, ref = fold(man_pairs, ref, "work_id", WORK_FIELDS, thresholds, method)
    return ref, man_pairs, work_pairs
