"""Scans of token features, vectors, pair lists, catalogues and id lists."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkin.functions.ids import repair_id
from textkin.schemas import CATALOGUE_AUTHORS, CATALOGUE_BOOKS, PAIRS
from textkin.session import parts_of

_SECTION = T.StructType([T.StructField(
    "tokenPosCount", T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType())))])
FEATURES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("features", T.StructType([T.StructField("pages", T.ArrayType(T.StructType([
        T.StructField("seq", T.StringType()), T.StructField("header", _SECTION),
        T.StructField("body", _SECTION), T.StructField("footer", _SECTION)])))])),
    T.StructField("_bad", T.StringType()),
])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Page feature files (JSON, any Hadoop codec); unreadable ones keep their text in ``_bad``."""
    return (
        spark.read.schema(FEATURES).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad").json(path)
    )


def feature_tokens(features: DataFrame, section="body", lowercase=True) -> DataFrame:
    """(htid, page, token, count) from feature files, parts of speech merged.

    Pages are dealt by volume before their tokens become rows, so no row per token is shuffled, here or by what keeps to volumes.
    """
    pages = features.where(F.col("_bad").isNull()).select(
        F.col("id").alias("htid"), F.explode("features.pages").alias("p"))
    merged = F.transform_values(F.col(f"p.{section}.tokenPosCount"), lambda _, pos: F.aggregate(
        F.map_values(pos), F.lit(0).cast("long"), lambda s, x: s + x))
    dealt = pages.select("htid", F.col("p.seq").cast("int").alias("page"), merged.alias("counts")).where("counts IS NOT NULL").repartition(
        parts_of(features, 1 << 20), "htid")
    rows = dealt.select("htid", "page", F.explode("counts").alias("token", "n"))
    token = F.lower("token") if lowercase else F.col("token")
    return rows.select("htid", "page", token.alias("token"), "n").groupBy(
        "htid", "page", "token").agg(F.sum("n").alias("count"))


def quarantine(features: DataFrame) -> DataFrame:
    """The unreadable feature records, for a quarantine table."""
    return features.where(F.col("_bad").isNotNull()).select("_bad")


def read_vectors(spark: SparkSession, path: str, htid: str = None) -> DataFrame:
    """Vector table, optionally one volume's chunks in order."""
    df = spark.read.parquet(path)
    return volume_chunks(df, htid) if htid else df


def volume_chunks(vectors: DataFrame, htid: str) -> DataFrame:
    return vectors.where(F.col("htid") == htid).orderBy("seq")


def duplicate_chunks(vectors: DataFrame, keys=("htid", "seq")) -> DataFrame:
    return vectors.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def first_source(tables: dict, key="htid") -> DataFrame:
    """Rows of the first source holding any row of a volume.

    ``tables`` maps source names to DataFrames in order of preference.
    """
    parts = [t.withColumn("source", F.lit(name)).withColumn("_p", F.lit(i))
             for i, (name, t) in enumerate(tables.items())]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    winner = rows.groupBy(key).agg(F.min("_p").alias("_p"))
    return rows.join(winner, [key, "_p"]).drop("_p")


def read_predictions(spark: SparkSession, path: str, suffix=r"\.predictions\.parquet") -> DataFrame:
    """Prediction files; the target id is part of the file path."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return target_from_path(df, suffix)


def target_from_path(df: DataFrame, suffix=r"\.predictions\.parquet") -> DataFrame:
    """Read the target from ``.../<target><suffix>[/part-...]`` and rename htid."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    out = df.select(
        F.regexp_extract(path, rf"([^/=]+){suffix}", 1).alias("target"), *df.columns)
    return out.withColumnRenamed("htid", "candidate")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS).json(path)


def read_catalogue_books(spark: SparkSession, path: str) -> DataFrame:
    """Second catalogue's book records; a missing author list gives id -1."""
    df = spark.read.schema(CATALOGUE_BOOKS).json(path)
    return df.withColumn("first_author_id", first_author(F.col("authors")))


def read_catalogue_authors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE_AUTHORS).json(path)


def first_author(authors):
    return F.coalesce(F.get(authors, 0)["author_id"], F.lit("-1"))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Hand-coded judgments with ids in path form repaired."""
    df = spark.read.schema("target string, candidate string, judgment string").option(
        "header", "true").csv(path)
    return df.withColumns({c: repair_id(F.col(c)) for c in ("target", "candidate")})


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed ids of text files, blanks skipped."""
    return (
        spark.read.text(path).select(F.trim("value").alias("htid"))
        .where(F.col("htid") != "").distinct()
    )
