"""Best copy of every cluster by scores; distances to its centroid and median."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.functions import vectors as vx
from textkin.operators.vectorize import mean_vectors, median_vectors, sum_vectors


def member_distances(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cosine distance of each member's mean vector to its cluster's sum and median vector."""
    vecs = members.select("cluster", "htid").join(mean_vectors(chunks), "htid")
    centroid = sum_vectors(vecs, ["cluster"]).withColumnRenamed("vec", "centroid")
    median = median_vectors(vecs, ["cluster"]).withColumnRenamed("vec", "median")
    return (
        vecs.join(centroid, "cluster").join(median, "cluster")
        .select("cluster", "htid", (1 - vx.cosine(F.col("vec"), F.col("centroid"))).alias("cent_dist"),
                (1 - vx.cosine(F.col("vec"), F.col("median"))).alias("med_dist"))
    )


def best_copies(scored: DataFrame, criteria) -> DataFrame:
    """Winning volume per cluster and criterion, also among ``access = 'allow'``.

    ``criteria`` maps output names to ``(column, 'min' | 'max')``; equal scores
    go to the smaller id. Only one struct per cluster travels to the reducers.
    """
    aggs = []
    open_ = F.col("access") == "allow"
    for name, (col, way) in criteria.items():
        score = F.round(F.col(col) if way == "min" else -F.col(col), 9)
        key = F.when(F.col(col).isNotNull(), F.struct(score.alias("s"), "htid"))
        aggs += [F.min(key)["htid"].alias(name), F.min(F.when(open_, key))["htid"].alias(name + "_pd")]
    return scored.groupBy("cluster").agg(*aggs)
