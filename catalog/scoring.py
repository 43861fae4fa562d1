"""Scoring, models and structured results (I3-I11, A20) and the flagship query."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.filters import GUESS_SQL, RELATED_SQL
from catalog.fixtures import q6, q6s, r6, r6s, sql
from catalog.joins import next_books, shops
from catalog.windows import chunk_ctes
from textkin.functions import labels
from textkin.operators import candidates, compare, evaluate, export, score, vectorize
from textkin.operators import tokens as tk
from textkin.operators.bands import bands_sql
from textkin.plans import relate
from textkin.plans.features import feature_table, pair_statistics
from textkin.schemas import JUDGMENTS, LABELS
from textkin.session import bucketed, cut, drop_bucketed, shuffle_parts


_FLAG_DIMS = 160
_FLAG_DIST = 0.25


def related_documents(spark, sf, chunk_size=500, dims=_FLAG_DIMS):
    """Flagship: whole texts to chunk vectors, neighbours, match statistics, metadata."""
    d = fx.docs(spark, sf)
    tokens = cut(tk.token_list(d), "tokens")
    chunks = cut(vectorize.hash_project(tk.chunk_token_list(tokens, chunk_size), dims=dims), "chunks")
    pairs = candidates.ann_candidates(chunks, n=300, min_count=2, max_dist=_FLAG_DIST)
    m = d.select("htid", "lang", "source")
    return (
        pairs.join(m.toDF("target", "target_lang", "target_source"), "target")
        .join(m.toDF("match", "match_lang", "match_source"), "match")
        .select("target", "match", "count", F.round("mean", 6).alias("mean"), F.round("prop_target", 6).alias("prop_target"),
                F.round("prop_match", 6).alias("prop_match"), "target_lang", "match_lang", "target_source", "match_source")
    )


def flagship_related_documents(spark, sf):
    return related_documents(spark, sf)


def _linear_model():
    """A fixed stand-in model: distances of the inputs' means to ten anchors, soft-maxed."""
    import numpy as np

    anchors = np.linspace(-1, 1, 10)

    def f(sim, wem):
        x = sim.mean(axis=1) * 4 + wem.mean(axis=1)
        e = np.exp(-np.abs(x[:, None] - anchors[None, :]) * 3)
        return e / e.sum(axis=1, keepdims=True)

    return f


def i3_batch_model(spark, sf):
    f = feature_table(next_books(spark, sf), fx.chunk_vectors(spark, sf).select("htid", "seq", "vec"), matrix_size=10, wem_form="mean_diff")
    p = score.predict_with(_linear_model, f, 100, 128)
    return p.select("left", "right", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in LABELS])


def _scored(spark, sf):
    return score.format_scores(fx.predictions(spark, sf), fx.meta(spark, sf))


def i4_format_scores(spark, sf):
    return _scored(spark, sf).select("target", "candidate", "guess", "title", "author", "rights_date_used", "oclc_num",
                                     F.round(F.col("relatedness").cast("double") + 1e-9, 4).alias("relatedness"))


def i5_relate_volumes(spark, sf):
    """Candidates, features, model and scores for every vector book."""
    c = fx.chunk_vectors(spark, sf).select("htid", "seq", "vec")
    m = shops(spark, sf)
    for col in ("description", "rights_date_used", "oclc_num", "isbn"):
        m = m.withColumn(col, F.lit(None).cast("long" if col == "rights_date_used" else "string"))
    out = relate.relate(c, m, c.select("htid").distinct(), lambda f: score.predict_with(_linear_model, f, 150 * 150, 128),
                        min_count=2, max_dist=1.25)
    return out.select("target", "candidate", "guess", F.round("relatedness", 4).alias("relatedness"))


def judged_chunks(tokens):
    """Two kinds of vectors of the same chunks. The counts stay dealt by volume, as ``tokens`` are; that table is dropped."""
    counted = bucketed(tk.chunk_token_list(tokens, 100), "counted", ["htid"], shuffle_parts(tokens.sparkSession), dealt=True)
    drop_bucketed(tokens)
    chunks = [cut(vectorize.hash_project(counted, dims=d), "chunks") for d in (64, 32)]
    drop_bucketed(counted)
    return chunks


def judged_statistics(spark, sf):
    """Statistics of document pairs over two kinds of chunk vectors, judged: copies and versions (SWSM) and others (RANDDIFF)."""
    wide, narrow = judged_chunks(fx.token_table(spark, sf))
    same = fx.doc_pairs(spark, sf).withColumn("judgment", F.lit("SWSM"))
    d = fx.table(spark, sf, "documents").select("doc_id")
    name = lambda c: F.concat(F.lit("d."), c.cast("string"))
    other = d.select(name(F.col("doc_id")).alias("left"), name(F.col("doc_id") + 7).alias("right")).join(
        d.select(name(F.col("doc_id")).alias("right")), "right", "left_semi").join(same, ["left", "right"], "left_anti")
    judged = cut(same.unionByName(other.select("left", "right").withColumn("judgment", F.lit("RANDDIFF"))), "judged")
    stats = compare.derived_stats(pair_statistics(judged.select("left", "right"), wide, run_thresholds=[0.5, 0.6, 0.7, 0.8],
                                                  distance_thresholds=[0.1, 0.3, 0.5], others={"srp": narrow}))
    stats = stats.join(judged, ["left", "right"])
    return cut(stats.fillna(0.0, subset=score.feature_columns(stats)), "stats")


def _training(spark, sf):
    return score.hash_split(judged_statistics(spark, sf), ["left", "right"], (0.8, 0.2))


def i6_train_forest(spark, sf):
    """A forest for every subset of the features, trained on hash-split pairs and judged on the rest: confusion counts."""
    train, test = _training(spark, sf)
    out = None
    for subset in score.FEATURE_SETS:
        features = score.feature_columns(train, subset)
        if not features:
            raise ValueError(f"no features in {subset}")
        model = score.train_classifier(train, features, kind="forest", numTrees=4, maxDepth=4, seed=1)
        part = _confusion(model, test).withColumn("subset", F.lit(subset))
        out = part if out is None else out.unionByName(part)
    return out


def _confusion(model, test):
    names = F.array(*[F.lit(j) for j in JUDGMENTS])
    out = model.transform(test).withColumn("guess", F.element_at(names, F.col("prediction").cast("int") + 1))
    return out.groupBy("judgment", "guess").agg(F.count("*").alias("n"))


def i7_feature_importances(spark, sf):
    train, _ = _training(spark, sf)
    features = score.feature_columns(train)
    model = score.train_classifier(train, features, kind="forest", numTrees=5, maxDepth=5, seed=1)
    return score.feature_importances(model, features, spark)


def i8_classification_report(spark, sf):
    """The guessed judgment as prediction, the one without GRSIM and RANDDIFF as truth."""
    rel = fx.predictions(spark, sf)
    pairs = rel.select(labels.guess(JUDGMENTS[:8]).alias("judgment"), labels.guess().alias("guess"))
    return evaluate.classification_report(pairs).select("label", "support", *r6s("precision", "recall", "f1"))


def i9_split(spark, sf):
    parts = score.hash_split(fx.predictions(spark, sf), ["target", "candidate"])
    out = None
    for name, p in zip(("train", "test", "validate"), parts):
        n = p.groupBy(F.lit(name).alias("part")).agg(F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def i10_decision_tree(spark, sf):
    train, test = _training(spark, sf)
    return _confusion(score.train_classifier(train, score.feature_columns(train), kind="tree", maxDepth=4, seed=1), test)


def i11_group_features(spark, sf):
    l = fx.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    g = score.group_features(l, ["q", "p", "d", "t"], k=5)
    return score.zscore_profile(g, "cluster", ["q", "p", "d", "t"])


def _blank_some(author):
    """Some volumes have no author, so blank authors stand on either side of a pair."""
    return F.when(F.col("htid").substr(-1, 1).isin("3") & (F.col("title") > "m"), F.lit(None)).otherwise(author)


def structured(spark, sf):
    m = fx.meta(spark, sf).withColumn("author", _blank_some(F.col("author")))
    scored = score.format_scores(fx.predictions(spark, sf), m).withColumn("relatedness", F.round(F.col("relatedness").cast("double"), 4))
    scored = scored.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in LABELS})
    return export.structured_rows(scored, m)


def a20_structured_rows(spark, sf):
    return structured(spark, sf).select("target", "section", "field", "rank", "value", "confidence")


def a20_structured_documents(spark, sf):
    m = fx.meta(spark, sf)
    rows = cut(export.structured_rows(_scored(spark, sf), m), "rows")
    return export.structured_documents(rows, m, m.select("htid"))


QUERIES = {f.__name__: f for f in (
    flagship_related_documents, i3_batch_model, i4_format_scores, i5_relate_volumes, i6_train_forest, i7_feature_importances,
    i8_classification_report, i9_split, i10_decision_tree, i11_group_features, a20_structured_rows, a20_structured_documents)}

_G8 = "CASE " + " ".join(f"WHEN {c} = greatest({', '.join(LABELS[:8])}) THEN '{j}'" for j, c in zip(JUDGMENTS[:8], LABELS[:8])) + " END"
_SC = f"""SELECT target, candidate, {GUESS_SQL} AS guess, {", ".join(f"round({c}::FLOAT::DOUBLE, 4) AS {c}" for c in LABELS)},
  round({RELATED_SQL}::FLOAT::DOUBLE, 4) AS relatedness FROM fx_rel"""
_J = """SELECT s.*, m.title, m.author, m.description, m.rights_date_used, m.oclc_num, t.title AS t_title, t.author AS t_author,
  t.description AS t_description, t.rights_date_used AS t_rights_date_used, t.oclc_num AS t_oclc_num
  FROM sc s JOIN blanked m ON m.htid = candidate JOIN blanked t ON t.htid = target"""
_BLANKED = "SELECT * REPLACE (CASE WHEN right(htid, 1) = '3' AND title > 'm' THEN NULL ELSE author END AS author) FROM fx_meta"


def _values_sql(field, col, limit):
    return f"""SELECT DISTINCT target, 'related_metadata' AS section, '{field}' AS field, CAST(0 AS BIGINT) AS rank, CAST({col} AS VARCHAR) AS value,
      CAST(NULL AS INTEGER) AS confidence FROM j WHERE author = t_author AND guess IN ({", ".join(f"'{g}'" for g in limit)})
      AND ({col} <> t_{col} OR t_{col} IS NULL) AND {col} IS NOT NULL"""


_REL = " ".join(f"WHEN '{j}' THEN '{f}'" for f, j in export.RELATIONSHIPS.items())
_PROB = " ".join(f"WHEN '{j}' THEN p_{j.lower()}" for j in export.RELATIONSHIPS.values())
_A20 = " UNION ALL ".join(
    [_values_sql(f, c, l) for f, (c, l) in export.OTHER_VALUES.items()]
    + ["""SELECT target, 'relationships', field, row_number() OVER (PARTITION BY target, field ORDER BY p DESC, candidate) - 1, candidate,
        CAST(trunc(p * 100) AS INTEGER) FROM r""",
       "SELECT target, 'recommendations', 'similar books', rn - 1, candidate, NULL FROM simi",
       "SELECT DISTINCT target, 'recommendations', 'related authors', CAST(0 AS BIGINT), author, NULL FROM simi WHERE author IS NOT NULL"])
A20 = _A20
A20_VIEWS = dict(
    sc=_SC, blanked=_BLANKED, j=_J,
    r=f"SELECT target, candidate, CASE guess {_REL} END AS field, CASE guess {_PROB} END AS p FROM j WHERE author = t_author AND guess IN ({', '.join(repr(x) for x in export.RELATIONSHIPS.values())})",
    simi="""SELECT *, row_number() OVER (PARTITION BY target ORDER BY relatedness DESC, candidate) AS rn FROM j
      WHERE NOT coalesce(author = t_author, false) AND relatedness > 0.15 QUALIFY rn <= 20""")

FLAGSHIP = {
    **chunk_ctes(500),
    "counts": """SELECT t.htid, seq, token, CAST(sum(count) AS BIGINT) AS n FROM fx_token t JOIN chunk_pages p ON p.htid = t.htid AND p.page = t.page GROUP BY ALL""",
    "comps": f"""SELECT htid, seq, pos, CAST(sum(ln(1 + n) * {fx.sign_sql()}) AS FLOAT) AS x
      FROM (SELECT htid, seq, n, sha1(token || '#0') AS h, unnest(range(0, {_FLAG_DIMS})) AS pos FROM counts) GROUP BY htid, seq, pos""",
    "vecs": """SELECT htid, seq, list(x::DOUBLE ORDER BY pos) AS vec, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS n FROM comps GROUP BY htid, seq""",
    "cells": f"SELECT htid, seq, unnest({bands_sql(_FLAG_DIMS, _FLAG_DIST)}) AS cell FROM vecs",
    "nn": f"""SELECT * FROM (SELECT target, target_seq, match, match_seq,
        round(sqrt(greatest(0, 2 - 2 * list_dot_product(a.vec, b.vec) / (a.n * b.n))), 7) AS dist FROM (
          SELECT DISTINCT x.htid AS target, x.seq AS target_seq, y.htid AS match, y.seq AS match_seq FROM cells x JOIN cells y ON x.cell = y.cell)
        JOIN vecs a ON a.htid = target AND a.seq = target_seq JOIN vecs b ON b.htid = match AND b.seq = match_seq)
      WHERE dist <= {_FLAG_DIST} QUALIFY row_number() OVER (PARTITION BY target, target_seq ORDER BY dist, match, match_seq) <= 300""",
    "ext": "SELECT htid, count(*) AS length FROM vecs GROUP BY htid",
    "ds": """SELECT target, match, count, mean, count / t.length AS prop_target, count / m.length AS prop_match, t.length AS tl FROM (
        SELECT target, match, count(*) AS count, avg(dist) AS mean FROM (SELECT target, match, match_seq, min(dist) AS dist FROM nn GROUP BY ALL) GROUP BY ALL)
      JOIN ext t ON t.htid = target JOIN ext m ON m.htid = match""",
    "dm": "SELECT 'd.' || doc_id AS htid, lang, source FROM documents",
}

ORACLE = {
    "flagship_related_documents": sql("""SELECT target, match, count, round(mean, 6) AS mean, round(prop_target, 6) AS prop_target,
        round(prop_match, 6) AS prop_match, a.lang AS target_lang, b.lang AS match_lang, a.source AS target_source, b.source AS match_source
        FROM ds JOIN dm a ON a.htid = target JOIN dm b ON b.htid = match WHERE count >= least(2, tl) AND target <> match""", "fx_token", **FLAGSHIP),
    "i4_format_scores": sql(f"""SELECT target, candidate, {GUESS_SQL} AS guess, title, author, CAST(rights_date_used AS BIGINT) AS rights_date_used, oclc_num,
        round({RELATED_SQL}::FLOAT::DOUBLE + 1e-9, 4) AS relatedness FROM fx_rel JOIN fx_meta ON htid = candidate""", "fx_rel", "fx_meta"),
    "i8_classification_report": sql(f"""SELECT label, CAST(s AS BIGINT) AS support, {q6('p', 'precision')}, {q6('r', 'recall')},
        {q6('CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END', 'f1')} FROM (SELECT label, s,
          CASE WHEN g = 0 THEN 0 ELSE c / g END AS p, CASE WHEN s = 0 THEN 0 ELSE c / s END AS r FROM (
            SELECT label, (SELECT count(*) FROM pr WHERE t = label) AS s, (SELECT count(*) FROM pr WHERE g = label) AS g,
              (SELECT count(*) FROM pr WHERE t = label AND g = label) AS c FROM (SELECT t AS label FROM pr UNION SELECT g FROM pr)))""", "fx_rel",
        pr=f"SELECT {_G8} AS t, {GUESS_SQL} AS g FROM fx_rel"),
    "i9_split": sql("""SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'test' ELSE 'validate' END AS part, count(*) AS n FROM (
        SELECT CAST('0x' || substr(md5('1234|' || target || '|' || candidate), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM fx_rel) GROUP BY 1""", "fx_rel"),
    "a20_structured_rows": sql(_A20, "fx_rel", "fx_meta", **A20_VIEWS),
}
