"""Session settings and durable cuts of long lineages."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="textkin", master=None, **conf) -> SparkSession:
    """A session with the settings the plans are written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can read: ``spark.checkpoint.dir``.

    Where that is unset, a subfolder of the warehouse, which is shared wherever tables are.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def remove(spark: SparkSession, path: str):
    """Delete a folder of intermediate data on any Hadoop file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def cut(df: DataFrame, name="cut", replaces=()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors and ends the lineage, so
    iterative jobs re-read files instead of re-running earlier rounds.
    ``replaces``: earlier cuts that nothing needs once this one is written; their folders go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    for old in replaces:
        remove(spark, old.cut_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions of a shuffle before any are joined, which is the number of buckets that needs none."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or parts)


def parts_of(df: DataFrame, bytes_each: int) -> int:
    """Partitions of a shuffle of what ``df`` reads, so that a task gets about ``bytes_each`` bytes of its files however large they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_parts(df.sparkSession), min(size // bytes_each, 1 << 15))


def bucketed(df: DataFrame, name: str, keys, buckets: int, dealt=False) -> DataFrame:
    """Write ``df`` to the shared folder as a table in buckets by ``keys``, for joins without a shuffle.

    ``dealt``: its partitions hold whole buckets already. ``drop_bucketed`` removes the table.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df = df if dealt else df.repartition(buckets, *keys)
    df.write.bucketBy(buckets, *keys).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.table_name, out.cut_path = table, path
    return out


def drop_bucketed(df: DataFrame):
    """Drop a table that ``bucketed`` wrote, files and all."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.table_name}")
    remove(df.sparkSession, df.cut_path)
