"""Incremental ingest (T1, T2) and the table export (K13)."""

import uuid

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.aggregates import STD
from catalog.filters import RELATED_SQL
from catalog.fixtures import q6, q6s, r6s, sql
from catalog.joins import clusters
from catalog.scans import scratch
from textkin.schemas import LABELS
from textkin.sources import sinks
from textkin.streaming import ingest


def _ingested(spark, sf):
    """Prediction files per target library, ingested in two runs of the stream."""
    p = fx.predictions(spark, sf).withColumnRenamed("candidate", "htid").withColumn(
        "file", F.concat("target", F.lit(".predictions.parquet")))
    root, table, sums, ckpt = (scratch(spark, n) for n in ("files", "table", "sums", "checkpoint"))
    schema = p.drop("target", "file").schema
    lib = F.substring_index("target", ".", 1)
    # A file belongs to one library of targets; the library is the id in its path.
    part = p.withColumn("file", F.concat(lib, F.lit(".predictions.parquet"))).withColumn("row_target", F.col("target"))
    for turn, cond in enumerate((lib < "l3", lib >= "l3")):
        part.where(cond).drop("target").withColumnRenamed("row_target", "volume").write.partitionBy("file").mode("append").parquet(root)
        stream = ingest.prediction_stream(spark, root, schema.add("volume", "string") if turn == 0 else schema, files_per_batch=4)
        stream = stream.drop("target").withColumnRenamed("volume", "target")
        ingest.ingest(stream, table, sums, ckpt).awaitTermination()
    return table, sums


def t1_incremental_ingest(spark, sf):
    table, _ = _ingested(spark, sf)
    return spark.read.parquet(table).select("target", "candidate", "flipped", *r6s("p_partof", "p_contains"))


def t2_reciprocal_view(spark, sf):
    _, sums = _ingested(spark, sf)
    base = scratch(spark, "base")
    ingest.compact(spark, sums, base)
    return ingest.reciprocal_view(spark, sums, base, include_std=True).select(
        "target", "candidate", "count", *r6s(*LABELS, "relatedness", "std_diff"))


def k13_export_tables(spark, sf):
    """Two tables written, all but the largest exported, the export read back."""
    tag = uuid.uuid4().hex[:8]
    small, large = f"works_{tag}", f"pairs_{tag}"
    path = scratch(spark, "export")
    try:
        for name, df in ((small, clusters(spark, sf)), (large, fx.predictions(spark, sf))):
            df.write.option("path", scratch(spark, name)).saveAsTable(name)
        others = [t.name for t in spark.catalog.listTables() if t.name not in (small, large)]
        done = sinks.export_tables(spark, path, skip=[sinks.largest_table(spark), large, *others])
        assert done == [small], done
    finally:
        for name in (small, large):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.parquet(f"{path}/{small}")


QUERIES = {f.__name__: f for f in (t1_incremental_ingest, t2_reciprocal_view, k13_export_tables)}

ORACLE = {
    "t1_incremental_ingest": sql("""SELECT least(target, candidate) AS target, greatest(target, candidate) AS candidate, target > candidate AS flipped,
        round(CASE WHEN target > candidate THEN p_contains ELSE p_partof END + 1e-10, 6) AS p_partof,
        round(CASE WHEN target > candidate THEN p_partof ELSE p_contains END + 1e-10, 6) AS p_contains FROM fx_rel""", "fx_rel"),
    "t2_reciprocal_view": sql(f"SELECT target, candidate, count, {q6s(*LABELS)}, {q6(RELATED_SQL, 'relatedness')}, {q6('std_diff')} FROM s", "fx_rel", s=STD),
    "k13_export_tables": sql("SELECT htid, author || '/' || title AS man_id, title AS work_id FROM fx_meta", "fx_meta"),
}
