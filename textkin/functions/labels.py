"""Expressions over the ten judgment probabilities."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textkin.schemas import JUDGMENTS, LABELS, RELATEDNESS_WEIGHTS, label_col


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in cols])


def guess(labels=JUDGMENTS) -> Column:
    """Most probable judgment; the earlier label wins a tie.

    Every probability occurs once in the expression, which keeps generated code
    small however the columns were computed.
    """
    best = F.greatest(*[F.struct(F.col(label_col(j)).cast("double").alias("p"), F.lit(-i).alias("i"))
                        for i, j in enumerate(labels)])
    return F.element_at(F.array(*[F.lit(j) for j in labels]), F.lit(1) - best["i"])


def relatedness(weights=RELATEDNESS_WEIGHTS) -> Column:
    """Weighted mean of the probabilities."""
    terms = [F.col(label_col(j)).cast("double") * F.lit(float(w)) for j, w in weights.items()]
    return reduce(lambda a, b: a + b, terms) / F.lit(float(sum(weights.values())))


def one_hot(c: Column, labels=JUDGMENTS) -> Column:
    """0/1 array over the labels; all zero for an unknown judgment."""
    return F.array(*[F.coalesce((c == F.lit(j)).cast("int"), F.lit(0)) for j in labels])


def confidence(p: Column) -> Column:
    """Whole percent, truncated."""
    return (p.cast("double") * 100).cast("int")


def complete(df: DataFrame) -> DataFrame:
    """Rows whose ten probabilities are all present and not NaN.

    One condition per column: a single predicate over all ten would make
    Catalyst's constraint inference try every combination of aliases.
    """
    ok = F.lit(True)
    for c in LABELS:
        if c in df.columns:
            ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(ok)


def canonical(df: DataFrame, left="target", right="candidate") -> DataFrame:
    """Put the smaller id first; a swapped row trades PARTOF for CONTAINS."""
    swap = F.col(left) > F.col(right)
    partof, contains = label_col("PARTOF"), label_col("CONTAINS")
    new = {
        left: F.least(left, right),
        right: F.greatest(left, right),
        partof: F.when(swap, F.col(contains)).otherwise(F.col(partof)),
        contains: F.when(swap, F.col(partof)).otherwise(F.col(contains)),
        "flipped": swap,
    }
    if "guess" in df.columns:
        new["guess"] = (
            F.when(swap & (F.col("guess") == "PARTOF"), F.lit("CONTAINS"))
            .when(swap & (F.col("guess") == "CONTAINS"), F.lit("PARTOF"))
            .otherwise(F.col("guess"))
        )
    return df.withColumns(new)
