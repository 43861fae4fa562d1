"""The structured result of a target: related metadata, relationships, recommendations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.functions.ids import volume_link
from textkin.functions.labels import confidence
from textkin.operators.ranks import positions, top_per_group
from textkin.schemas import DEFAULT_FIELDS, label_col
from textkin.session import cut

# ---- fixed values -------------------------------------------------------
SAME_WORK = ("SWSM", "SWDE")
OTHER_VALUES = {
    "other years": ("rights_date_used", SAME_WORK), "other titles": ("title", SAME_WORK),
    "other OCLC numbers": ("oclc_num", SAME_WORK), "other enumchron values": ("description", SAME_WORK),
    "titles within this work": ("title", ("CONTAINS",)),
    "titles of works that contain this work": ("title", ("PARTOF",)),
}
RELATIONSHIPS = {
    "identical works": "SWSM", "different expressions": "SWDE", "other volumes of the larger work": "WP_DV",
    "this work contains": "CONTAINS", "this work is a part of": "PARTOF",
}
MIN_RELATEDNESS = 0.15
MAX_SIMILAR = 20
# -------------------------------------------------------------------------

BOOK = ["title", "author", "description", "rights_date_used", "oclc_num", "isbn"]


def _with_target(scored: DataFrame, meta: DataFrame) -> DataFrame:
    t = meta.select(F.col("htid").alias("target"), *[F.col(c).alias("t_" + c) for c in BOOK])
    return scored.join(t, "target")


def structured_rows(scored: DataFrame, meta: DataFrame) -> DataFrame:
    """All list entries of every target's result, one row each.

    ``(target, section, field, rank, value, confidence, book...)``: value is the
    metadata value or the related volume's id. Long form keeps a target with very
    many relations spread over tasks; only the 20 similar books are a cut.
    """
    # Read once per list below.
    rows = cut(_with_target(scored, meta), "scored")
    same = rows.where(F.col("author") == F.col("t_author"))
    blank_book = [F.lit(None).cast(scored.schema[c].dataType).alias(c) for c in BOOK]
    out = []

    def values(df, section, field, col, limit):
        differs = (F.col(col) != F.col("t_" + col)) | F.col("t_" + col).isNull() | (F.col("t_" + col).cast("string") == "")
        v = df.where(F.col("guess").isin(*limit) & differs & F.col(col).isNotNull()).select(
            "target", F.col(col).cast("string").alias("value")).distinct()
        return v.select("target", F.lit(section).alias("section"), F.lit(field).alias("field"),
                        F.lit(0).cast("long").alias("rank"), "value", F.lit(None).cast("int").alias("confidence"), *blank_book)

    for field, (col, limit) in OTHER_VALUES.items():
        out.append(values(same, "related_metadata", field, col, limit))

    names = F.create_map(*[x for f, j in RELATIONSHIPS.items() for x in (F.lit(j), F.lit(f))])
    prob = F.coalesce(*[F.when(F.col("guess") == j, F.col(label_col(j)).cast("double")) for j in RELATIONSHIPS.values()])
    listed = same.withColumns({"field": F.try_element_at(names, F.col("guess")), "p": prob}).where("field IS NOT NULL")
    ranked = positions(listed, ["target", "field"], F.floor((1 - F.col("p")) * 4096), [F.desc("p"), "candidate"], pos="rank")
    out.append(ranked.select("target", F.lit("relationships").alias("section"), "field", "rank",
                             F.col("candidate").alias("value"), confidence(F.col("p")).alias("confidence"), *BOOK))

    # A blank author is nobody's, so such books are by another author than any target.
    others = rows.where(~F.coalesce(F.col("author") == F.col("t_author"), F.lit(False)) & (F.col("relatedness") > MIN_RELATEDNESS))
    similar = top_per_group(others, ["target"], [F.desc("relatedness"), "candidate"], MAX_SIMILAR, rank_col="rn")
    out.append(similar.select(
        "target", F.lit("recommendations").alias("section"), F.lit("similar books").alias("field"),
        (F.col("rn") - 1).cast("long").alias("rank"), F.col("candidate").alias("value"),
        F.lit(None).cast("int").alias("confidence"), *BOOK))
    authors = similar.where(F.col("author").isNotNull()).select("target", F.col("author").alias("value")).distinct()
    out.append(authors.select("target", F.lit("recommendations").alias("section"), F.lit("related authors").alias("field"),
                              F.lit(0).cast("long").alias("rank"), "value", F.lit(None).cast("int").alias("confidence"), *blank_book))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def structured_documents(rows: DataFrame, meta: DataFrame, targets: DataFrame) -> DataFrame:
    """Nested JSON result per target: ``(target, document)``.

    ``structured_rows`` is the form that any number of relations fits; this is its nested copy for output, one document for
    each of ``targets``. Targets without any relation get a document holding the volume alone.
    """
    item = F.when(
        (F.col("section") == "relationships") | (F.col("field") == "similar books"),
        F.to_json(F.struct(F.col("value").alias("htid"), "title", "author", "description",
                           F.col("rights_date_used").alias("year"), "oclc_num", "isbn", "confidence"))
    ).otherwise(F.to_json(F.struct("value")))
    wanted = targets.select(F.col("htid").alias("target")).distinct()
    lists = (
        rows.join(wanted, "target", "left_semi").withColumn("item", item).groupBy("target", "section", "field")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "item"))), lambda s: s["item"]).alias("items"))
    )
    nested = lists.groupBy("target").agg(  # at most 13 fields
        F.sort_array(F.collect_list(F.struct("section", "field", "items"))).alias("lists"))
    base = meta.join(wanted.withColumnRenamed("target", "htid"), "htid", "left_semi").select(
        F.col("htid").alias("target"), F.struct(*DEFAULT_FIELDS, volume_link(F.col("htid")).alias("link")).alias("volume"))
    doc = F.struct("volume", F.coalesce("lists", F.array().cast(nested.schema["lists"].dataType)).alias("lists"))
    return base.join(nested, "target", "left").select("target", F.to_json(doc).alias("document"))
