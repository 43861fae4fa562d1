"""From volume ids to relationship documents as one batch job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.operators.candidates import all_candidates, ann_candidates, meta_candidates
from textkin.operators.export import structured_documents, structured_rows
from textkin.operators.score import format_scores, several_candidates
from textkin.plans.features import feature_table
from textkin.session import cut
from textkin.sources.sinks import remaining


def candidate_pairs(chunks: DataFrame, meta: DataFrame, targets: DataFrame, n=300, min_count=3, max_dist=0.25,
                    exact=False, **meta_options) -> DataFrame:
    ann = ann_candidates(chunks, targets, n, min_count, max_dist, exact=exact)
    return all_candidates(ann, meta_candidates(meta, targets, **meta_options))


def relate(chunks: DataFrame, meta: DataFrame, targets: DataFrame, predict, done: DataFrame = None,
           matrix_size=150, **options) -> DataFrame:
    """Scored predictions for every unfinished target.

    ``predict(features) -> DataFrame`` adds the ten probability columns to rows of
    ``(left, right, sim_x, wem_x)``. Pairs without vectors drop out in the joins.
    """
    todo = remaining(targets, done) if done is not None else targets
    pairs = cut(several_candidates(candidate_pairs(chunks, meta, todo, **options)), "pairs")
    feats = feature_table(pairs.select(F.col("target").alias("left"), F.col("match").alias("right")),
                          chunks, matrix_size=matrix_size, wem_form="mean_diff")
    scored = predict(feats).withColumnsRenamed({"left": "target", "right": "candidate"})
    return format_scores(scored, meta)


def documents(scored: DataFrame, meta: DataFrame, targets: DataFrame) -> DataFrame:
    return structured_documents(cut(structured_rows(scored, meta), "rows"), meta, targets)
