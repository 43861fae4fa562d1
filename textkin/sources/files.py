"""Listing and versioned table folders on any Hadoop file system."""

from pyspark.sql import DataFrame, SparkSession


def list_dir(spark: SparkSession, path: str) -> list:
    """Names directly under a folder; empty when it does not exist."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath))


def versions(spark: SparkSession, path: str) -> list:
    """Committed versions of a table folder, oldest first."""
    found = [int(n.split("-", 1)[1]) for n in list_dir(spark, path) if n.startswith("version-")]
    return [v for v in sorted(found) if "_SUCCESS" in list_dir(spark, f"{path}/version-{v}")]


def write_version(df: DataFrame, path: str, sort_by=None) -> int:
    """Write the next version beside the current one; readers switch on commit."""
    spark = df.sparkSession
    v = (versions(spark, path) or [0])[-1] + 1
    if sort_by:
        df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
    df.write.mode("overwrite").parquet(f"{path}/version-{v}")
    return v


def read_version(spark: SparkSession, path: str, version: int = None) -> DataFrame:
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no committed version under {path}")
    return spark.read.parquet(f"{path}/version-{version or found[-1]}")
