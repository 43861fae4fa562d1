"""Incremental ingest of prediction files with Structured Streaming."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkin.functions.labels import canonical, relatedness
from textkin.schemas import LABELS
from textkin.sources.files import list_dir
from textkin.sources.sinks import append_batch
from textkin.sources.tables import target_from_path


SUMS = [*LABELS, "relatedness", *[c + "_sq" for c in LABELS]]


def prediction_stream(spark: SparkSession, path: str, schema, files_per_batch=1000, suffix=r"\.predictions\.parquet") -> DataFrame:
    """Stream of prediction files; every file is read once, its target comes from its path."""
    raw = (
        spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )
    return target_from_path(raw, suffix)


def partial_sums(flipped: DataFrame) -> DataFrame:
    """Sums, sums of squares and counts per pair: the mergeable form of reciprocal means and of their disagreement."""
    x = {c: F.col(c).cast("double") for c in LABELS}
    return flipped.groupBy("target", "candidate").agg(
        *[F.sum(v).alias(c) for c, v in x.items()], F.sum(relatedness()).alias("relatedness"),
        *[F.sum(v * v).alias(c + "_sq") for c, v in x.items()], F.count("*").alias("count"))


def ingest(stream: DataFrame, table: str, sums: str, checkpoint: str):
    """Append flipped rows and partial sums of all new files, then stop.

    Each micro-batch owns one partition folder in both tables and overwrites it,
    so a batch replayed after a failure changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        flipped = canonical(batch)
        append_batch(flipped, table, batch_id)
        # Read back what was written instead of running the file scan twice.
        stored = batch.sparkSession.read.schema(flipped.schema).parquet(f"{table}/ingest_batch={batch_id}")
        append_batch(partial_sums(stored), sums, batch_id)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def compact(spark: SparkSession, sums: str, base: str) -> int:
    """Merge all batch sums into a new base version and return the last batch it covers."""
    done = _batches(spark, sums)
    last = done[-1]
    merged = _merge(_read_sums(spark, sums, base, done))
    merged.write.mode("overwrite").parquet(f"{base}/through-{last}")
    return last


def _batches(spark, sums):
    return sorted(int(n.split("=")[1]) for n in list_dir(spark, sums) if n.startswith("ingest_batch="))


def _bases(spark, base):
    found = [int(n.split("-")[1]) for n in list_dir(spark, base) if n.startswith("through-")] if base else []
    return sorted(v for v in found if "_SUCCESS" in list_dir(spark, f"{base}/through-{v}"))


def _read_sums(spark, sums, base, batches):
    """The newest committed base and the batches after it."""
    bases = _bases(spark, base)
    through = bases[-1] if bases else -1
    paths = [f"{sums}/ingest_batch={b}" for b in batches if b > through]
    if bases:
        paths.append(f"{base}/through-{through}")
    return spark.read.parquet(*paths)


def _merge(parts: DataFrame) -> DataFrame:
    return parts.groupBy("target", "candidate").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.sum("count").alias("count"))


def reciprocal_view(spark: SparkSession, sums: str, base: str = None, min_count=2, include_std=False) -> DataFrame:
    """Current reciprocal means over everything ingested so far; ``std_diff`` adds up the labels' standard deviations."""
    merged = _merge(_read_sums(spark, sums, base, _batches(spark, sums))).where(F.col("count") >= min_count)
    means = [(F.col(c) / F.col("count")).alias(c) for c in [*LABELS, "relatedness"]]
    spread = [F.sqrt(F.greatest(F.lit(0.0), F.col(c + "_sq") / F.col("count") - F.pow(F.col(c) / F.col("count"), 2))) for c in LABELS]
    std = [reduce(lambda a, b: a + b, spread).alias("std_diff")] if include_std else []
    return merged.select("target", "candidate", *means, *std, "count")
