"""Scans and sources (S): files are written from the given tables and read back."""

import uuid

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import sql
from textkin.functions.ids import path_safe, split_chunk_id
from textkin.operators import relations, vectorize
from textkin.operators import tokens as tk
from textkin.schemas import METADATA
from textkin.session import parts_of, shared_dir
from textkin.sources import metadata, sinks, tables
from textkin.sources.files import read_version, write_version


PAGES = 256


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _dump(spark, sf, sep):
    """Metadata in dump layout: every named column, absent ones null."""
    m = fx.meta(spark, sf)
    have = set(m.columns)
    out = m.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA])
    path = scratch(spark, "dump")
    quote = ""
    if sep == ",":  # commas and quotes inside values, and years written as floats
        quote = '"'
        out = out.withColumns({"title": F.concat("title", F.lit(', "'), "description", F.lit('"')),
                               "rights_date_used": F.col("rights_date_used").cast("double")})
    out.write.option("sep", sep).option("compression", "gzip").option("quote", quote).option("escape", quote or "\\").csv(path)
    return path


META_FIELDS = ["htid", "title", "author", "description", "rights_date_used", "us_gov_doc_flag", "oclc_num"]
_meta_out = "SELECT " + ", ".join(META_FIELDS) + " FROM fx_meta"


def s1_metadata_ingest(spark, sf):
    """A comma-separated dump with quoted values, clustered by id."""
    path, dump = scratch(spark, "store"), _dump(spark, sf, ",")
    if metadata.rejected_lines(spark, dump, sep=",").take(1):
        raise ValueError("lines of the dump could not be read")
    metadata.create_store(metadata.read_delimited(spark, dump, sep=","), path)
    return metadata.read_store(spark, path, META_FIELDS)


def s2_metadata_tsv(spark, sf):
    return metadata.read_delimited(spark, _dump(spark, sf, "\t"), columns=META_FIELDS)


def s3_metadata_in_list(spark, sf):
    ids = fx.edges(spark, sf).select(fx.volume_id("b").alias("htid"))
    return metadata.get_volumes(fx.meta(spark, sf), ids, ["htid", "title", "author"])


def s4_partition_pass(spark, sf):
    """A whole-table pass, counting per partition in Arrow batches."""
    def sizes(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)], "pages": [int(pdf["page_count"].sum())]})

    per = fx.meta(spark, sf).select("htid", "page_count").mapInPandas(sizes, "n long, pages long")
    return per.agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))


def s5_sorted_glob(spark, sf):
    path = scratch(spark, "parts")
    fx.meta(spark, sf).select("htid", "title").write.parquet(f"{path}/a.parquet")
    out = scratch(spark, "sorted")
    sinks.sorted_backup(spark.read.parquet(f"{path}/*.parquet"), out, "htid")
    return spark.read.parquet(out)


def s6_feature_files(spark, sf):
    """Token features written as page feature JSON, then read as tokens."""
    documents = fx.table(spark, sf, "documents")
    tokens = tk.token_list(fx.docs(spark, sf, parts_of(documents, 2 << 20)))
    pages = tokens.groupBy("htid", "page").agg(F.map_from_entries(F.collect_list(F.struct(
        "token", F.create_map(F.lit("NN"), F.col("count"))))).alias("m"))
    # A record holds up to PAGES of a volume's pages, as feature files do: its id and layout are not repeated for every page.
    page = F.struct(F.format_string("%08d", "page").alias("seq"), F.struct(F.col("m").alias("tokenPosCount")).alias("body"))
    rows = pages.groupBy("htid", F.floor(F.col("page") / PAGES)).agg(F.collect_list(page).alias("pages")).select(
        F.col("htid").alias("id"), F.struct("pages").alias("features"))
    path = scratch(spark, "features")
    rows.write.option("compression", "bzip2").json(path)
    back = tables.feature_tokens(tables.read_features(spark, path))
    return back.groupBy("htid").agg(F.count("*").alias("rows"), F.sum("count").alias("tokens"))


def s7_dimension_check(spark, sf):
    return vectorize.dimension_report(fx.chunk_vectors(spark, sf), 64)


def s8_volume_chunks(spark, sf):
    """Every volume's chunks, clustered by volume on disk; duplicates counted."""
    path = scratch(spark, "vectors")
    sinks.sorted_backup(fx.chunk_vectors(spark, sf), path, "htid")
    v = tables.read_vectors(spark, path)
    twice = tables.duplicate_chunks(v).count()
    return v.groupBy("htid").agg(
        F.count("*").alias("chunks"), F.min("seq").alias("first"), F.max("seq").alias("last"),
        F.lit(twice).cast("long").alias("duplicates"))


def _sources(spark, sf):
    v = fx.chunk_vectors(spark, sf).select("htid", "seq", "label")
    return {"glove": v.where("label < 5"), "glove_fake": v}


def s9_first_source(spark, sf):
    return tables.first_source(_sources(spark, sf))


def s10_combined_metadata(spark, sf):
    m = fx.meta(spark, sf)
    store = m.select("htid", "title", "oclc_num")
    own = fx.lines(spark, sf).groupBy(fx.volume_id("part").alias("htid")).agg(
        F.max(F.col("qty").cast("int")).alias("page_count"), F.min(F.col("l_orderkey").cast("string")).alias("oclc_num"))
    return metadata.combined(store, own)


def s11_predictions_from_paths(spark, sf):
    """One file per target library block; the block name comes back from the path."""
    p = fx.predictions(spark, sf)
    root = scratch(spark, "pred")
    p.select(F.col("candidate").alias("htid"), "p_swsm", F.concat(
        F.substring_index("target", ".", 1), F.lit(".predictions.parquet")).alias("file")
    ).write.partitionBy("file").parquet(root)
    back = tables.read_predictions(spark, root)
    return back.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("candidate").alias("candidates"),
                                      F.round(F.sum("p_swsm"), 6).alias("swsm"))


def s12_json_pairs(spark, sf):
    pairs = fx.predictions(spark, sf).select(F.col("target").alias("left"), F.col("candidate").alias("right"),
                                             F.lit("SWSM").alias("judgment"), F.lit("order").alias("notes"))
    path = scratch(spark, "pairs")
    sinks.write_json(pairs, path)
    return tables.read_pairs(spark, path)


def s13_catalogue_books(spark, sf):
    b = fx.books(spark, sf)
    path = scratch(spark, "books")
    sinks.write_json(b.withColumn("authors", F.when(F.col("book_id") % 9 != 0, F.col("authors"))
                                  .otherwise(F.array().cast(b.schema["authors"].dataType))), path, "gzip")
    return tables.read_catalogue_books(spark, path).select(
        F.col("book_id").cast("long").alias("book_id"), "title", "first_author_id")


def s14_judgments(spark, sf):
    p = fx.edges(spark, sf).select(F.concat(F.lit("x="), "a").alias("target"), F.concat(F.lit("x="), "b").alias("candidate"),
                                   F.when(F.col("r") > 0.9, "SWSM").otherwise("SWDE").alias("judgment"))
    path = scratch(spark, "judged")
    p.write.option("header", "true").csv(path)
    return tables.read_judgments(spark, path)


def s15_id_lists(spark, sf):
    path = scratch(spark, "ids")
    fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("  "), fx.volume_id("l_partkey"), F.lit(" "))).write.text(path)
    return tables.read_id_list(spark, path)


def s16_json_field(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.col("props").alias("json"))
    return metadata.json_field(e, "k").select("event_id", F.col("k").try_cast("int").alias("k"))


def s17_concatenate_vectors(spark, sf):
    v = fx.chunk_vectors(spark, sf).select("htid", "seq", "vec")
    both = vectorize.concat_vector_tables([v, v.withColumn("htid", F.concat(F.lit("copy."), "htid"))], 64)
    return both.groupBy("htid").agg(F.count("*").alias("chunks"), F.round(
        F.sum(F.element_at("vec", 1).cast("double")), 6).alias("x"))


def k2_stub_columns(spark, sf):
    return sinks.with_stub(fx.meta(spark, sf).select("htid"))


def k15_extend_store(spark, sf):
    path = scratch(spark, "versions")
    m = fx.meta(spark, sf)
    write_version(m.select("htid", "title"), path, "htid")
    metadata.extend_store(spark, path, m.where("page_count > 100").select("htid", "page_count"))
    return read_version(spark, path)


QUERIES = {f.__name__: f for f in (
    s1_metadata_ingest, s2_metadata_tsv, s3_metadata_in_list, s4_partition_pass, s5_sorted_glob,
    s6_feature_files, s7_dimension_check, s8_volume_chunks, s9_first_source, s10_combined_metadata,
    s11_predictions_from_paths, s12_json_pairs, s13_catalogue_books, s14_judgments, s15_id_lists,
    s16_json_field, s17_concatenate_vectors, k2_stub_columns, k15_extend_store)}

ORACLE = {
    "s1_metadata_ingest": sql(_meta_out.replace("title,", """title || ', "' || description || '"' AS title,"""), "fx_meta"),
    "s2_metadata_tsv": sql(_meta_out, "fx_meta"),
    "s3_metadata_in_list": sql(f"""SELECT htid, title, author FROM fx_meta
        WHERE key IN (SELECT b FROM fx_edges)""", "fx_meta", "fx_edges"),
    "s4_partition_pass": sql("SELECT count(*) AS n, CAST(sum(page_count) AS BIGINT) AS pages FROM fx_meta", "fx_meta"),
    "s5_sorted_glob": sql("SELECT htid, title FROM fx_meta ORDER BY htid", "fx_meta"),
    "s6_feature_files": sql("""SELECT htid, count(*) AS rows, CAST(sum(count) AS BIGINT) AS tokens
        FROM fx_token GROUP BY htid""", "fx_token"),
    "s7_dimension_check": sql("""SELECT CAST(len(vec) AS INTEGER) AS dims, count(*) AS n, len(vec) = 64 AS expected
        FROM fx_chunk GROUP BY len(vec)""", "fx_chunk"),
    "s8_volume_chunks": sql("""SELECT htid, count(*) AS chunks, min(seq) AS first, max(seq) AS last,
        (SELECT count(*) FROM (SELECT 1 FROM fx_chunk GROUP BY htid, seq HAVING count(*) > 1)) AS duplicates
        FROM fx_chunk GROUP BY htid""", "fx_chunk"),
    "s9_first_source": sql("""SELECT htid, seq, label, 'glove' AS source FROM fx_chunk WHERE label < 5
        UNION ALL SELECT htid, seq, label, 'glove_fake' FROM fx_chunk
        WHERE htid NOT IN (SELECT htid FROM fx_chunk WHERE label < 5)""", "fx_chunk"),
    "s10_combined_metadata": sql(f"""SELECT m.htid, m.title, coalesce(m.oclc_num, o.oclc_num) AS oclc_num,
        coalesce(o.page_count, 1) AS page_count
        FROM fx_meta m LEFT JOIN (SELECT part, max(CAST(floor(qty) AS INTEGER)) AS page_count,
          min(CAST(l_orderkey AS VARCHAR)) AS oclc_num FROM fx_lines GROUP BY part) o ON o.part = m.key""",
        "fx_meta", "fx_lines"),
    "s11_predictions_from_paths": sql("""SELECT split_part(target, '.', 1) AS target, count(*) AS n,
        count(DISTINCT candidate) AS candidates, round(sum(p_swsm), 6) AS swsm FROM fx_rel GROUP BY 1""", "fx_rel"),
    "s12_json_pairs": sql("""SELECT target AS "left", candidate AS "right", 'SWSM' AS judgment, 'order' AS notes
        FROM fx_rel""", "fx_rel"),
    "s13_catalogue_books": sql("""SELECT book_id, title, CASE WHEN book_id % 9 <> 0 THEN author_id ELSE '-1' END
        AS first_author_id FROM fx_books""", "fx_books"),
    "s14_judgments": sql("""SELECT 'x/' || a AS target, 'x/' || b AS candidate,
        CASE WHEN r > 0.9 THEN 'SWSM' ELSE 'SWDE' END AS judgment FROM fx_edges""", "fx_edges"),
    "s15_id_lists": f"SELECT DISTINCT {fx.sql_id('l_partkey')} AS htid FROM lineitem",
    "s16_json_field": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "s17_concatenate_vectors": sql("""SELECT htid, count(*) AS chunks, round(sum(CAST(vec[1] AS DOUBLE)), 6) AS x
        FROM (SELECT htid, vec FROM fx_chunk UNION ALL SELECT 'copy.' || htid, vec FROM fx_chunk) GROUP BY htid""", "fx_chunk"),
    "k2_stub_columns": sql("""SELECT htid, split_part(htid, '.', 1) AS lib,
        list_aggregate([substr(substr(htid, strpos(htid, '.') + 1), CAST(i AS BIGINT), 1)
          FOR i IN range(1, len(htid) - strpos(htid, '.') + 1, 3)], 'string_agg', '') AS stub FROM fx_meta""", "fx_meta"),
    "k15_extend_store": sql("""SELECT htid, title, CASE WHEN page_count > 100 THEN page_count END AS page_count
        FROM fx_meta""", "fx_meta"),
}
