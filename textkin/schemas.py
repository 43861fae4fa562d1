"""Fixed names, weights and table schemas."""

from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------
JUDGMENTS = ["SWSM", "SWDE", "WP_DV", "PARTOF", "CONTAINS", "OVERLAPS",
             "AUTHOR", "SIMDIFF", "GRSIM", "RANDDIFF"]
RELATEDNESS_WEIGHTS = {
    "SWSM": 1.0, "SWDE": 0.7, "WP_DV": 0.7, "PARTOF": 0.6, "CONTAINS": 0.6,
    "OVERLAPS": 0.6, "AUTHOR": 0.3, "SIMDIFF": 0.1, "GRSIM": 0.4, "RANDDIFF": 0.0,
}
META_COLUMNS = [
    "htid", "access", "rights", "ht_bib_key", "description", "source",
    "source_bib_num", "oclc_num", "isbn", "issn", "lccn", "title", "imprint",
    "rights_reason_code", "rights_timestamp", "us_gov_doc_flag",
    "rights_date_used", "pub_place", "lang", "bib_fmt", "collection_code",
    "content_provider_code", "responsible_entity_code",
    "digitization_agent_code", "access_profile_code", "author",
]
DEFAULT_FIELDS = ["htid", "title", "author", "description", "rights_date_used", "oclc_num", "isbn"]
# -------------------------------------------------------------------------


def label_col(judgment: str) -> str:
    """Probability column of a judgment, e.g. ``p_swsm``.

    The prefix keeps the AUTHOR probability apart from the author field:
    Spark resolves names without regard to case.
    """
    return "p_" + judgment.lower()


LABELS = [label_col(j) for j in JUDGMENTS]

_META_TYPES = {"us_gov_doc_flag": T.IntegerType(), "rights_date_used": T.IntegerType()}

METADATA = T.StructType(
    [T.StructField(c, _META_TYPES.get(c, T.StringType())) for c in META_COLUMNS]
)
PAIRS = T.StructType([
    T.StructField("left", T.StringType()), T.StructField("right", T.StringType()),
    T.StructField("judgment", T.StringType()), T.StructField("notes", T.StringType()),
])
CATALOGUE_AUTHORS = T.StructType([
    T.StructField("author_id", T.StringType()), T.StructField("name", T.StringType()),
])
CATALOGUE_BOOKS = T.StructType([
    T.StructField("book_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("title_without_series", T.StringType()),
    T.StructField("work_id", T.StringType()), T.StructField("isbn", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StructType([
        T.StructField("author_id", T.StringType()), T.StructField("role", T.StringType())]))),
    T.StructField("similar_books", T.ArrayType(T.StringType())),
    T.StructField("average_rating", T.StringType()), T.StructField("link", T.StringType()),
    T.StructField("publication_year", T.StringType()),
    T.StructField("edition_information", T.StringType()),
])
