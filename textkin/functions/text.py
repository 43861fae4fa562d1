"""Bibliographic and free-text normalisation as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
TRAILING_PARTS = r"(/[^/]*){1,2}$"
TITLE_STOPS = ["; by", "[by]", "; illustrated by"]
CONTRIBUTOR_CLAUSE = (
    r"(?i)[.,;\])\[] +?[(\[]?"
    r"(assembl|photo|arrang|select|compil|record|collect|edit|translat).{0,100}by.*\.?"
)
BY_CLAUSE = r"[.,] [bB]y (the .{0,30})?([A-Z][\p{L}\p{N}_]+ [A-Z\p{L}\p{N}_+]|author).*\.?"
DESCRIPTION_RULES = [
    (r"v\. ", "v."),
    (r"^(\d+)$", "v.$1"),
    (r"copy ?|cop\.", "c."),
    (r"\.[0 ]+", "."),
    (r"\((.*?)\)", "$1"),
    (r"vol\.", "v."),
    (r"\.$", ""),
    (r"(v|pt|c)(\d)", "$1.$2"),
]
AUTHOR_YEARS = r"-?\d{4}"
INVERSION = r"^(.*) ([A-Z].*)$"
VOLUME_NUMBER = r"^v\.\d\d?$"
KEY_LENGTH = 35
# -------------------------------------------------------------------------

EDGE_SPACE = r"^\s+|\s+$"
EDGE_DOTS = r"^\.+|\.+$"
NOT_WORD = r"[^\p{L}\p{N}_]"
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def strip_dots(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_DOTS, "")


def clean_title(c: Column) -> Column:
    """Title without responsibility statements and trailing slash parts."""
    c = strip(F.regexp_replace(c, TRAILING_PARTS, ""))
    for stop in TITLE_STOPS:
        c = F.substring_index(c, stop, 1)
    c = F.regexp_replace(c, CONTRIBUTOR_CLAUSE, "")
    c = F.regexp_replace(c, BY_CLAUSE, "")
    return strip_dots(strip(c))


def clean_description(c: Column) -> Column:
    """Normal form of an enumeration statement (``v.001`` -> ``v.1``)."""
    c = F.lower(c)
    for pattern, replacement in DESCRIPTION_RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def clean_author(c: Column) -> Column:
    """Author heading without life dates, at most its first two comma parts."""
    c = strip_dots(strip(F.regexp_replace(c, AUTHOR_YEARS, "")))
    return F.array_join(F.slice(F.split(c, ","), 1, 2), ",")


def simple_title(c: Column) -> Column:
    """Match key of a title: cleaned, lower case, main part, word characters."""
    c = F.lower(clean_title(c))
    c = F.regexp_replace(c, r"(?s)[:/\\].*$", "")
    return F.substring(F.regexp_replace(c, NOT_WORD, ""), 1, KEY_LENGTH)


def invert_name(c: Column) -> Column:
    """``First Last`` -> ``Last, First``."""
    return F.regexp_replace(c, INVERSION, "$2, $1")


def title_prefix(c: Column, n=30) -> Column:
    return F.substring(c, 1, n)


def volume_number(c: Column) -> Column:
    """Number of a ``v.N`` description, null for any other form."""
    d = clean_description(c)
    return F.when(d.rlike(VOLUME_NUMBER), F.regexp_extract(d, r"(\d+)", 1).cast("int"))


def numeric_or_null(c: Column) -> Column:
    """Number held as text; ``None`` and other text become null."""
    return F.nullif(c, F.lit("None")).try_cast("double")


def parse_int_list(c: Column) -> Column:
    """``"['1', '2']"`` -> array of integers."""
    return F.transform(
        F.from_json(F.translate(c, "'", '"'), "array<string>"), lambda x: x.cast("long"))


def text_tokens(c: Column) -> Column:
    """Lower-case word tokens of a text, in order."""
    return F.filter(F.split(F.lower(c), TOKEN_BREAK), lambda t: t != "")


def char_ngrams(c: Column, lo=3, hi=4) -> Column:
    """Character n-grams of every word, words marked at both ends."""
    words = F.transform(text_tokens(c), lambda w: F.concat(F.lit("<"), w, F.lit(">")))

    def sized(w, n):
        # A lambda with two arguments would be handed the element's index.
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
        return F.when(F.length(w) >= n, F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    def grams(w):
        return F.flatten(F.array(*[sized(w, n) for n in range(lo, hi + 1)]))

    return F.flatten(F.transform(words, grams))
