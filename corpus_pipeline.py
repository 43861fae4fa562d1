"""From raw documents to a training mix: each stage works on all rows that the one before it kept."""

import uuid

from pyspark.sql import functions as F

from textkin.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from textkin.llm.tables import fresh, table
from textkin.session import remove, shared_dir


def clean(spark, docs, sf_dir):
    """Documents that are not toxic. Labels of one fold of five are left for judging the scores.

    Every row is judged by its own text: null and empty texts get the bias of the model and stay, copies go or stay
    together. Rows without id stay too. Without labels of both kinds nothing is learned and only fixed patterns count.
    """
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    grammar = toxicity.fit(docs, labels)
    verdict = fresh(docs, "predicted")
    return toxicity.score(docs, grammar, keep=tuple(docs.columns)).where(F.col(verdict) == 0).select(*docs.columns)


def lines(spark, docs, sf_dir):
    """Documents without the boilerplate lines of their source.

    Which document of a group of near copies survives is the next stage's work. A group counts as one page of its source here, so
    that no line is taken for boilerplate because of copies. A text that is all boilerplate goes on whole. Rows without
    source or text go on as they are; rows without id count by their text; repeated rows count once.
    """
    group, known = fresh(docs, "near_copies"), fresh(docs, "near_copies_of")
    near = near_dedup.near_duplicates(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias(known)).agg(F.min("component_id").alias(group))
    told = docs.select("doc_id", "source", "text").join(near, F.col("doc_id") == F.col(known), "left")
    bad = line_dedup.boilerplate(told, page=group)
    return line_dedup.drop_boilerplate(docs, spare=True, bad_lines=bad).select(*docs.columns)


def unique(spark, docs, sf_dir):
    """One document of each group of near copies: the one with the smallest id.

    Null and empty texts have no copies and stay, as do rows without id. Rows that repeat an id stay or go together.
    """
    return near_dedup.drop_near_duplicates(docs)


def untested(spark, docs, sf_dir):
    """Documents that contain no benchmark item. Null and empty texts contain none; rows without id stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Documents drawn by raked weights, with tokens, topic, probability and weight.

    Null sources, languages and texts are classes of their own. Rows that repeat an id are drawn together.
    """
    drawn = fresh(docs, "sampled")
    return mixing.mix_to_targets(docs).where(F.col(drawn)).drop(drawn)


STAGES = [("toxicity", clean), ("line dedup", lines), ("near dedup", unique), ("decontamination", untested), ("mixing", mix)]

#: Toxicity scores are learned, so no SQL gives these rows; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder and read again; only the last one's rows are left there."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            remove(spark, f"{at}/{k - 1}")
    return docs
