"""The relation tables: directed predictions, reciprocal means, reports."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.functions.labels import canonical, total
from textkin.schemas import LABELS


def flip_judgments(df: DataFrame) -> DataFrame:
    """Canonical pair order with PARTOF and CONTAINS exchanged on swapped rows."""
    return canonical(df)


def reciprocal_means(flipped: DataFrame, include_std=False, min_count=2) -> DataFrame:
    """Mean probabilities of pairs predicted from both sides."""
    cols = [c for c in LABELS + ["relatedness"] if c in flipped.columns]
    aggs = [F.avg(F.col(c).cast("double")).alias(c) for c in cols]
    if include_std:
        aggs.append(reduce(lambda a, b: a + b, [F.stddev_pop(F.col(c).cast("double")) for c in LABELS])
                    .alias("std_diff"))
    return (
        flipped.groupBy("target", "candidate").agg(*aggs, F.count("*").alias("count"))
        .where(F.col("count") >= min_count)
    )


def high_confidence(df: DataFrame, fields=("p_swsm",), min_probability=0.99) -> DataFrame:
    """Canonical pairs whose chosen probabilities add up to more than the threshold."""
    return df.where((total(fields) > min_probability) & (F.col("target") < F.col("candidate")))


def top_ids(df: DataFrame, side="target", n=10000) -> DataFrame:
    """Ids with most rows."""
    return df.groupBy(side).agg(F.count("*").alias("count")).orderBy(F.desc("count"), side).limit(n)


def with_metadata(df: DataFrame, meta: DataFrame, fields, side="target", prefix="") -> DataFrame:
    """Join chosen metadata fields to one side of a relation."""
    m = meta.select(F.col("htid").alias(side), *[F.col(f).alias(prefix + f) for f in fields])
    return df.join(m, side)


def both_metadata(df: DataFrame, meta: DataFrame, fields) -> DataFrame:
    out = with_metadata(df, meta, fields, "target", "target_")
    return with_metadata(out, meta, fields, "candidate", "candidate_")


def either_side(df: DataFrame, htid: str) -> DataFrame:
    """Rows naming a volume on either side: two prunable scans, no OR."""
    return df.where(F.col("target") == htid).unionByName(
        df.where((F.col("candidate") == htid) & (F.col("target") != htid)))


def either_side_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``either_side`` for a table of ids: rows keyed by the id they name."""
    wanted = ids.select("htid").distinct()
    as_target = wanted.join(df, F.col("htid") == F.col("target"))
    as_candidate = wanted.join(df, F.col("htid") == F.col("candidate")).where("target <> candidate")
    return as_target.unionByName(as_candidate)


def ingested_ids(table: DataFrame) -> DataFrame:
    """Volumes whose own predictions are in the canonical table.

    The asking volume is the target of an unflipped row and the candidate of a
    flipped one.
    """
    return table.select(F.when(F.col("flipped"), F.col("candidate")).otherwise(F.col("target"))
                        .alias("htid")).distinct()


def stage_inventory(targets: DataFrame, done: DataFrame) -> DataFrame:
    """State of every volume from one pass over ``(htid, stage)`` rows.

    Stages: ann, meta, predictions, data. Output ``(htid, state)``; a volume may
    be in more than one state.
    """
    flags = done.groupBy("htid").agg(*[
        F.max(F.when(F.col("stage") == s, True)).alias(s)
        for s in ("ann", "meta", "predictions", "data")])
    all_ids = targets.select("htid", F.lit(True).alias("wanted")).join(flags, "htid", "full")
    f = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("ann", "meta", "predictions", "data", "wanted")}
    states = {
        "justann": f["ann"] & ~f["meta"] & ~f["predictions"],
        "justmeta": f["meta"] & ~f["ann"] & ~f["predictions"],
        "candidates_no_predictions": f["ann"] & f["meta"] & ~f["predictions"],
        "predictions_no_data": f["predictions"] & ~f["data"],
        "data_complete": f["data"],
        "nocandidates": f["wanted"] & ~f["ann"] & ~f["meta"],
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in states.items()]), lambda x: x.isNotNull())
    return all_ids.select("htid", F.explode(found).alias("state"))
