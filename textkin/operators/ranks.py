"""Numbering, running totals and samples that never put one hot group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textkin.functions.ids import shuffle_key


def top_per_group(df: DataFrame, keys, order, k: int, rank_col=None) -> DataFrame:
    """First ``k`` rows per group.

    ``row_number() <= k`` is planned with a group limit before the shuffle, so a
    hot group sends at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def positions(df: DataFrame, keys, bucket: Column, order, pos="pos", size=None) -> DataFrame:
    """0-based position of every row of a group, in (bucket, order) order.

    Rows are numbered inside (group, bucket); the bucket counts, one row per
    bucket, give the offsets. ``bucket`` must sort like ``order`` and split a
    group finely enough for one task to hold a bucket.
    """
    keys = list(keys)
    d = df.withColumn("_b", bucket)
    per = d.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    group = [F.col(k) for k in keys] or [F.lit(1)]
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *[F.col(k).alias("_k_" + k) for k in keys], F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(*group)).alias("_size"))
    on = F.col("_b") == F.col("_ob")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("_k_" + k))
    local = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = (
        d.withColumn("_rn", F.row_number().over(local))
        .join(offsets, on)
        .withColumn(pos, F.col("_off") + F.col("_rn") - 1)
    )
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_b", "_ob", "_off", "_rn", "_size", *["_k_" + k for k in keys])


def shuffled_positions(df: DataFrame, keys, ids, seed=1234, pos="pos", size=None) -> DataFrame:
    """Positions in a stable pseudo-random order (65,536 buckets per group)."""
    key = shuffle_key(*[F.col(c) for c in ids], seed=seed)
    d = df.withColumn("_key", key)
    out = positions(d, keys, F.substring("_key", 1, 4), ["_key", *ids], pos, size)
    return out.drop("_key")


def global_positions(df: DataFrame, ids, pos="pos") -> DataFrame:
    """Number all rows from 0 without an unpartitioned window."""
    return shuffled_positions(df, [], ids, pos=pos)


def _sums_before(per: DataFrame, keys, at: str, value: str, fan: int, levels: int) -> DataFrame:
    """``(keys, at, _off)``: the sum of ``value`` over smaller ``at`` of the group, by a tree of sums.

    Every level adds up ``fan`` neighbouring entries, so below the top no window holds more than ``fan`` rows.
    """
    if not levels:
        before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return per.select(*keys, at, F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_off"))
    up = f"_up{levels}"
    placed = per.withColumn(up, F.floor(F.col(at) / fan))
    above = _sums_before(placed.groupBy(*keys, up).agg(F.sum(value).alias("_sum")), keys, up, "_sum", fan, levels - 1)
    inside = Window.partitionBy(*keys, up).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select(*keys, at, up, F.coalesce(F.sum(value).over(inside), F.lit(0)).alias("_in"))
    return own.join(above, [*keys, up]).select(*keys, at, (F.col("_in") + F.col("_off")).alias("_off"))


def running_total(df: DataFrame, keys, order: str, value: str, out: str, block=1024, levels=0) -> DataFrame:
    """Inclusive running sum over a numeric order column.

    Blocks of ``block`` order units are summed first; the prefix over blocks plus
    the running sum inside a block is the result. One row per (keys, order) is
    expected. Where a group may be the whole table, ``levels`` gives the tree of block sums so many more levels of 1024
    entries each; with three, the top one has an entry for 10^12 order units.
    """
    keys = list(keys)
    d = df.withColumn("_blk", F.floor(F.col(order) / block))
    per = d.groupBy(*keys, "_blk").agg(F.sum(value).alias("_s"))
    offsets = _sums_before(per, keys, "_blk", "_s", 1024, levels)
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        d.withColumn("_in", F.sum(value).over(inside))
        .join(offsets, [*keys, "_blk"])
        .withColumn(out, F.col("_off") + F.col("_in"))
        .drop("_blk", "_in", "_off")
    )


def sample_rows(df: DataFrame, n: int, ids, seed=1234) -> DataFrame:
    """Exactly ``n`` pseudo-random rows (a distributed top-n on the shuffle key)."""
    return df.orderBy(shuffle_key(*[F.col(c) for c in ids], seed=seed), *ids).limit(n)


def sample_fraction(df: DataFrame, fraction: float, ids, seed=1234) -> DataFrame:
    """About ``fraction`` of the rows, the same ones on every run and retry."""
    cut = F.lit(format(int(fraction * 0x100000000), "08x") if fraction < 1 else "g")
    return df.where(F.substring(shuffle_key(*[F.col(c) for c in ids], seed=seed), 1, 8) < cut)


def sample_groups(df: DataFrame, key: str, n: int, seed=1234) -> DataFrame:
    """All rows of ``n`` pseudo-random groups."""
    chosen = sample_rows(df.select(key).distinct(), n, [key], seed)
    return df.join(chosen, key, "left_semi")


def slice_positions(df: DataFrame, start: int, end: int, ids, seed=1234) -> DataFrame:
    """Rows ``start:end`` of the shuffled order."""
    return shuffled_positions(df, [], ids, seed).where(
        (F.col("pos") >= start) & (F.col("pos") < end)).drop("pos")
