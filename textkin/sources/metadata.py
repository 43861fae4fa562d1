"""The volume metadata store: ingest, look-ups, projections, extension."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from textkin.schemas import DEFAULT_FIELDS, METADATA
from textkin.sources.files import read_version, write_version

REJECTED = "_rejected"


def _reader(spark, path, sep, schema, header, quote):
    # Years come as floats from some writers ("1999.0").
    loose = StructType([StructField(f.name, DoubleType() if isinstance(f.dataType, IntegerType) else f.dataType) for f in schema]
                       + [StructField(REJECTED, StringType())])
    quote = ('"' if sep == "," else "") if quote is None else quote
    return (spark.read.schema(loose).option("sep", sep).option("header", header).option("quote", quote).option("escape", quote or "\\")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED).csv(path))


def read_delimited(spark: SparkSession, path: str, sep="\t", columns=None, schema=METADATA,
                   header=False, quote=None) -> DataFrame:
    """Typed scan of a delimited metadata dump (plain or gzip), pruned to ``columns``.

    ``quote``: by default ``"`` for comma-separated dumps (doubled inside a value) and none for others.
    """
    df = _reader(spark, path, sep, schema, header, quote)
    kinds = {f.name: f.dataType for f in schema}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns or kinds])


def rejected_lines(spark: SparkSession, path: str, sep="\t", schema=METADATA, header=False, quote=None) -> DataFrame:
    """Lines of a dump with another number of fields or with values of another type: ``(line, ...)`` with what could be read."""
    df = _reader(spark, path, sep, schema, header, quote)
    return df.where(F.col(REJECTED).isNotNull()).select(F.col(REJECTED).alias("line"), *[f.name for f in schema])


def create_store(df: DataFrame, path: str, key="htid", partitions=None) -> None:
    """Write metadata clustered by id, so that point look-ups prune row groups."""
    spread = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    spread.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def get_where(meta: DataFrame, clause: str, fields=None) -> DataFrame:
    """Rows satisfying a predicate string."""
    out = meta.where(F.expr(clause))
    return out.select(*fields) if fields else out


def get_volume(meta: DataFrame, htid: str, fields=None) -> DataFrame:
    """Point look-up; the equality reaches the parquet scan."""
    return meta.where(F.col("htid") == htid).select(*(fields or DEFAULT_FIELDS))


def get_volumes(meta: DataFrame, ids: DataFrame, fields=None) -> DataFrame:
    """Look-up of an id table of any size; Catalyst chooses the join."""
    out = meta.join(ids.select("htid").distinct(), "htid", "left_semi")
    return out.select(*fields) if fields else out


def get_fields(meta: DataFrame, fields=None, offset=0, limit=None) -> DataFrame:
    """Projection with defaults; with offset or limit the order is by id."""
    out = meta.select(*(fields or DEFAULT_FIELDS))
    if offset or limit is not None:
        out = out.orderBy("htid")
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def compare(pairs: DataFrame, meta: DataFrame,
            fields=("title", "author", "oclc_num", "page_count", "description")) -> DataFrame:
    """Both sides' metadata of every pair, side by side."""
    left = meta.select(F.col("htid").alias("left"), *[F.col(f).alias("left_" + f) for f in fields])
    right = meta.select(F.col("htid").alias("right"), *[F.col(f).alias("right_" + f) for f in fields])
    return pairs.join(left, "left").join(right, "right")


def combined(meta: DataFrame, volume_meta: DataFrame) -> DataFrame:
    """Store values first, the volume's own second; ``page_count`` defaults to 1."""
    shared = [c for c in meta.columns if c in volume_meta.columns and c != "htid"]
    own = [c for c in volume_meta.columns if c not in meta.columns]
    left, right = meta.alias("l"), volume_meta.alias("r")
    out = left.join(right, F.col("l.htid") == F.col("r.htid"), "full").select(
        F.coalesce("l.htid", "r.htid").alias("htid"),
        *[F.col("l." + c).alias(c) for c in meta.columns if c != "htid" and c not in shared],
        *[F.coalesce("l." + c, "r." + c).alias(c) for c in shared],
        *[F.col("r." + c).alias(c) for c in own])
    if "page_count" in out.columns:
        out = out.withColumn("page_count", F.coalesce("page_count", F.lit(1)))
    return out


def extend(meta: DataFrame, extension: DataFrame) -> DataFrame:
    """Add extension columns by id; a column already present is replaced."""
    new = [c for c in extension.columns if c != "htid"]
    return meta.drop(*new).join(extension, "htid", "left")


def extend_store(spark: SparkSession, path: str, extension: DataFrame) -> DataFrame:
    """Write the extended table as a new version; readers of the old one are undisturbed."""
    write_version(extend(read_version(spark, path), extension), path, "htid")
    return read_version(spark, path)


def json_field(volumes: DataFrame, field: str, col="json") -> DataFrame:
    """One field of each volume's JSON metadata, null where missing or malformed."""
    return volumes.withColumn(field, F.get_json_object(col, f"$.{field}"))
