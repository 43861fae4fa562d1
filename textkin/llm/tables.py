"""Small helpers on tables that the operators share."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkin.session import cut

#: Most rows of a table that is sent to every task; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Most bytes of such a table.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(field):
    """Bytes of a column's values."""
    kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0))
    return F.greatest(F.size(c), F.lit(0)) * 8 if kind.startswith("array") else F.lit(8)


def join_lookup(df: DataFrame, lookup: DataFrame, on, how="left", name="lookup", rows=BROADCAST_ROWS) -> DataFrame:
    """Join a table of unknown size: written and measured first, and broadcast only if its rows and bytes are few.

    The larger form is a plain join, whose skewed partitions Spark splits.
    """
    lookup = cut(lookup, name)
    size = sum((_bytes(f) for f in lookup.schema.fields), F.lit(0)).cast("long")
    n, total = lookup.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= rows and total <= BROADCAST_BYTES:
        lookup = F.broadcast(lookup)
    return df.join(lookup, on, how)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (Spark ignores case in names)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
