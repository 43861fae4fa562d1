"""Learned vectors of metadata fields: one skip-gram model per field over the character n-grams of its values.

A value's vector is the mean of its n-grams' vectors, so words that a model never met still have one by their parts. The
models are Spark's ``Word2Vec``; each is fitted on at most ``SAMPLE_VALUES`` different values of its field, the first ones by an md5 key, in
one partition and with a fixed seed, so that fitting repeats. Applying them takes every row: each distinct value once.
"""

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.functions import text as tx
from textkin.operators.ranks import sample_rows

SAMPLE_VALUES = 100_000
MIN_COUNT, WINDOW, ROUNDS = 2, 5, 3


def standard_fields() -> dict:
    """Columns and dimensions of the five fields of volume metadata; 100 dimensions together."""
    return {"title_description": (F.concat_ws(" / ", "title", F.coalesce("description", F.lit(""))), 20),
            "clean_title": (tx.clean_title(F.col("title")), 40), "short_title": (F.substring("title", 1, 40), 20),
            "author": (F.col("author"), 10), "description": (F.col("description"), 10)}


def _values(meta, column):
    return meta.select(column.alias("value")).where(F.col("value").isNotNull()).distinct()


def fit_field_models(meta: DataFrame, fields: dict, sample=SAMPLE_VALUES, seed=1234) -> dict:
    """A fitted model per field, or ``None`` for a field without any n-gram that occurs ``MIN_COUNT`` times."""
    models = {}
    for name, (column, dims) in fields.items():
        values = sample_rows(_values(meta, column), sample, ["value"], seed)
        grams = values.select(tx.char_ngrams(F.col("value")).alias("grams")).where(F.size("grams") > 0).coalesce(1)
        often = grams.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") >= MIN_COUNT)
        fit = Word2Vec(vectorSize=dims, minCount=MIN_COUNT, windowSize=WINDOW, maxIter=ROUNDS, numPartitions=1, seed=seed, inputCol="grams", outputCol="v")
        models[name] = None if often.isEmpty() else fit.fit(grams)
    return models


def save_field_models(models: dict, path: str):
    for name, model in models.items():
        if model is not None:
            model.write().overwrite().save(f"{path}/{name}")


def load_field_models(path: str, names) -> dict:
    return {name: Word2VecModel.load(f"{path}/{name}") for name in names}


def model_field_vectors(meta: DataFrame, fields: dict, models: dict, keep=("htid",)) -> DataFrame:
    """The fields' vectors one after the other; zeros stand for a null or empty field and for fields without model."""
    base = meta.select(*keep, *[c.alias("f_" + n) for n, (c, _) in fields.items()])
    for name, (_, dims) in fields.items():
        col, zeros = "f_" + name, F.array_repeat(F.lit(0.0).cast("float"), dims)
        if models.get(name) is None:
            base = base.withColumn("v_" + name, zeros)
            continue
        grams = _values(base, F.col(col)).select(F.col("value").alias(col), tx.char_ngrams(F.col("value")).alias("grams"))
        part = models[name].transform(grams).select(col, vector_to_array("v", "float32").alias("v_" + name))
        base = base.join(part, col, "left").withColumn("v_" + name, F.coalesce("v_" + name, zeros))
    return base.select(*keep, F.concat(*["v_" + n for n in fields]).alias("vec"))
