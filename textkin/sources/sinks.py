"""Stage tables, backups, records, lists and exports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkin.functions.ids import library, shuffle_key, stub
from textkin.functions.labels import one_hot
from textkin.session import cut
from textkin.sources.files import list_dir


def with_stub(df: DataFrame, col="htid") -> DataFrame:
    """Storage partition columns of an id."""
    return df.withColumns({"lib": library(F.col(col)), "stub": stub(F.col(col))})


def write_stage(df: DataFrame, path: str, col="htid") -> None:
    """Results of one stage, partitioned by library.

    Rows are clustered by stub inside each library: one folder per stub would
    mean one small file per few volumes.
    """
    (with_stub(df, col).repartitionByRange("lib", "stub", col).sortWithinPartitions("lib", "stub", col)
     .write.partitionBy("lib").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


def remaining(targets: DataFrame, done: DataFrame, key="htid") -> DataFrame:
    """Targets a stage has not finished yet."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def save_missing(df: DataFrame, path: str, key="htid", force=False) -> DataFrame:
    """Append only volumes the stage table does not hold; ``force`` replaces those it does.

    Replacing rewrites the libraries of the new volumes, with all other volumes in them.
    """
    spark = df.sparkSession
    if not list_dir(spark, path):
        write_stage(df, path, key)
    elif force:
        held = spark.read.parquet(path)
        new = with_stub(df, key)
        kept = held.join(new.select("lib").distinct(), "lib", "left_semi").join(new.select(key).distinct(), key, "left_anti")
        write_stage(cut(kept.drop("lib", "stub").unionByName(df), "stage"), path, key)
    else:
        new = remaining(df, spark.read.parquet(path), key)
        (with_stub(new, key).repartitionByRange("lib", "stub", key).sortWithinPartitions("lib", "stub", key)
         .write.partitionBy("lib").mode("append").parquet(path))
    return spark.read.parquet(path)


def append_batch(df: DataFrame, path: str, batch) -> None:
    """Append one ingest batch; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/ingest_batch={batch}")


def sorted_backup(df: DataFrame, path: str, key="target", partitions=None) -> None:
    """Files covering ascending key ranges, sorted inside."""
    spread = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    spread.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def create_table(df: DataFrame, name: str, sort_by) -> None:
    """Managed table sorted by key inside range partitions."""
    df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by).write.mode("overwrite").saveAsTable(name)


def copy_to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def copy_to_text(df: DataFrame, path: str) -> None:
    """One line per row of a single text column, such as documents that are JSON already."""
    df.write.mode("overwrite").text(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, compression="none", mode="overwrite") -> None:
    df.write.mode(mode).option("compression", compression).json(path)


def feature_records(rows: DataFrame) -> DataFrame:
    """Training records: matrix, mean vectors, ids, one-hot judgment, notes."""
    return rows.select(
        F.col("sim_x").cast("array<float>"), F.col("wem_x").cast("array<float>"), "left", "right",
        "judgment", one_hot(F.col("judgment")).alias("y"),
        F.coalesce("notes", F.lit("")).alias("notes"))


def _fits(sim_size, wem_size, labels):
    return F.coalesce((F.size("sim_x") == sim_size) & (F.size("wem_x") == wem_size) & (F.size("y") == labels), F.lit(False))


def bad_records(records: DataFrame, sim_size: int, wem_size: int, labels=10) -> DataFrame:
    """Records whose arrays have other lengths."""
    return records.where(~_fits(sim_size, wem_size, labels))


def read_records(spark: SparkSession, path: str, sim_size: int, wem_size: int, labels=10) -> DataFrame:
    """Records back from parquet; a wrong length fails the job, whichever columns are read."""
    bad = F.raise_error(F.concat(F.lit("bad record "), "left", F.lit(" "), "right"))
    return spark.read.parquet(path).where(F.when(_fits(sim_size, wem_size, labels), F.lit(True)).otherwise(bad.cast("boolean")))


def write_inventory(states: DataFrame, path: str) -> None:
    """Compressed id lists, one folder per state."""
    states.select("state", "htid").write.mode("overwrite").partitionBy("state").option(
        "compression", "gzip").text(path)


def export_tables(spark: SparkSession, path: str, skip=()) -> list:
    """Export all tables of the current database but the skipped ones."""
    done = []
    for t in spark.catalog.listTables():
        if t.isTemporary or t.name in skip:
            continue
        spark.table(t.name).write.mode("overwrite").parquet(f"{path}/{t.name}")
        done.append(t.name)
    return done


def largest_table(spark: SparkSession) -> str:
    """Name of the table with most bytes, from catalog statistics."""
    best, size = None, -1
    for t in spark.catalog.listTables():
        if not t.isTemporary:
            plan = spark.table(t.name)._jdf.queryExecution().optimizedPlan()
            bytes_ = int(str(plan.stats().sizeInBytes()))
            if bytes_ > size:
                best, size = t.name, bytes_
    return best


def nested_lists(rows: DataFrame, key: str, item_cols, ids) -> DataFrame:
    """``(key, data[])``: all items of a key in shuffled order, in one record as judges read it.

    ``rows`` is the form that any number of items per key fits; this is its nested copy for output.
    """
    order = F.struct(shuffle_key(*[F.col(c) for c in ids]).alias("k"), *ids, F.struct(*item_cols).alias("item"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(order)), lambda s: s["item"]).alias("data"))
