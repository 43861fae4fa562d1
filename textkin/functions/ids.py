"""Volume ids, chunk ids and storage paths as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
CHUNK_LONG = r"^(.*)-(\d+)-(\d+)-(\d+)$"
CHUNK_SHORT = r"^(.*)-(\d+)$"
CHUNK_FORMAT = "%s-%04d-%d-%d"
CHUNK_FORMAT_SHORT = "%s-%04d"
LINK_PREFIX = "http://hdl.handle.net/2027/"
SYNTHETIC_PREFIX = "fake."
# -------------------------------------------------------------------------


def library(htid: Column) -> Column:
    return F.substring_index(htid, ".", 1)


def volume_part(htid: Column) -> Column:
    return F.regexp_replace(htid, r"^[^.]*\.", "")


def stub(htid: Column) -> Column:
    """Every third character of the volume part."""
    v = volume_part(htid)
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1)), F.lit(3)),
                    lambda i: F.substring(v, i, F.lit(1))), "")


def stub_path(htid: Column) -> Column:
    return F.concat_ws("/", library(htid), stub(htid), path_safe(htid))


def path_safe(htid: Column) -> Column:
    return F.translate(htid, "/:", "=+")


def repair_id(c: Column) -> Column:
    """Undo the path form of an id: ``=`` stands for ``/``."""
    return F.translate(c, "=", "/")


def split_chunk_id(mtid: Column) -> dict:
    """Parts of a chunk id, read from the right so that ids may hold dashes."""
    long_form = mtid.rlike(CHUNK_LONG)

    def part(k_long, k_short):
        short = F.regexp_extract(mtid, CHUNK_SHORT, k_short) if k_short else F.lit(None)
        return F.when(long_form, F.regexp_extract(mtid, CHUNK_LONG, k_long)).otherwise(short)

    return {
        "htid": part(1, 1),
        "seq": part(2, 2).try_cast("int"),
        "start_page": part(3, 0).try_cast("int"),
        "end_page": part(4, 0).try_cast("int"),
    }


def chunk_id(htid: Column, seq: Column, start: Column = None, end: Column = None) -> Column:
    if start is None:
        return F.format_string(CHUNK_FORMAT_SHORT, htid, seq)
    return F.format_string(CHUNK_FORMAT, htid, seq, start, end)


def volume_link(htid: Column) -> Column:
    return F.concat(F.lit(LINK_PREFIX), htid)


def content_id(sources: Column) -> Column:
    """Id of a synthetic volume, derived from the ordered array of its sources."""
    return F.concat(F.lit(SYNTHETIC_PREFIX), F.substring(F.md5(F.array_join(sources, ",")), 1, 6))


def page_range(lo: Column, hi: Column) -> Column:
    return F.concat_ws("-", lo, hi)


def shuffle_key(*parts, seed=1234) -> Column:
    """A stable pseudo-random text key: the order used for every sample."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
