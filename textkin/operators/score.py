"""From pair features to judged relationships: models, scores, profiles."""

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkin.functions.ids import shuffle_key
from textkin.functions.labels import complete, guess, relatedness
from textkin.schemas import DEFAULT_FIELDS, JUDGMENTS, LABELS

# ---- fixed values: feature subsets as (kept, dropped) name patterns -------
FEATURE_SETS = {
    "allFeatures": (r".*", None), "noRight": (r".*", r"^r_"), "noLeft": (r".*", r"^l_"),
    "onlySW": (r"^(l_|r_)?sw_", None), "onlyQuantiles": (r"quantile", None), "onlyPropDist": (r"prop_dist", None),
    "onlyGlove": (r"^(l_|r_)?(mean|trunc|prop|quantile|min)", None), "onlySRP": (r"srp", None),
}
CLASSIFIERS = {
    "forest": RandomForestClassifier, "tree": DecisionTreeClassifier, "logistic": LogisticRegression,
    "bayes": NaiveBayes, "perceptron": MultilayerPerceptronClassifier,
}
# -------------------------------------------------------------------------


def feature_columns(df: DataFrame, subset="allFeatures") -> list:
    """Numeric columns of a named feature subset."""
    import re

    keep, drop = FEATURE_SETS[subset]
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return [c for c in numeric if re.search(keep, c) and not (drop and re.search(drop, c))]


def hash_split(df: DataFrame, ids, shares=(0.7, 0.15, 0.15), seed=1234):
    """Repeatable split by id: a row is in the same part on every run."""
    u = F.conv(F.substring(shuffle_key(*[F.col(c) for c in ids], seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    lo, parts = 0.0, []
    for s in shares:
        parts.append(df.where((u >= lo) & (u < lo + s)))
        lo += s
    return parts


def sample_classes(df: DataFrame, fractions: dict, ids, label="judgment", seed=1234) -> DataFrame:
    """A share of each class (none of classes that ``fractions`` leaves out), the same rows on every run."""
    u = F.conv(F.substring(shuffle_key(*[F.col(c) for c in ids], seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.lit(0.0)
    for name, part in fractions.items():
        share = F.when(F.col(label) == name, part).otherwise(share)
    return df.where(u < share)


def train_classifier(rows: DataFrame, features, label="judgment", kind="forest", **options):
    """MLlib pipeline over feature columns; classes follow the fixed judgment order."""
    index = StringIndexerModel.from_labels(JUDGMENTS, inputCol=label, outputCol="label_ix", handleInvalid="skip")
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    if kind == "perceptron":
        options.setdefault("layers", [len(features), 32, len(JUDGMENTS)])
    model = CLASSIFIERS[kind](featuresCol="features", labelCol="label_ix", **options)
    return Pipeline(stages=[index, vector, model]).fit(rows)


def feature_importances(model, features, spark) -> DataFrame:
    """Importances of a fitted tree or forest, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]  # one per feature column
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def predict(model, rows: DataFrame) -> DataFrame:
    """Ten probability columns per row from a fitted MLlib pipeline."""
    vector, clf = model.stages[1], model.stages[-1]
    p = vector_to_array(F.col("probability"))
    out = clf.transform(vector.transform(rows)).withColumn("_p", p)
    return out.select(*rows.columns, *[
        F.coalesce(F.get("_p", i), F.lit(0.0)).cast("float").alias(c) for i, c in enumerate(LABELS)])


def predict_with(model_factory: Callable, features: DataFrame, sim_size: int, wem_size: int, batch_size=256) -> DataFrame:
    """Any batch model as a plug-in: ``model_factory()`` returns ``f(sim, wem) -> (n, 10)``.

    The factory runs once per Python worker, so weights are loaded there. Features are read where Arrow put them; no copy of a batch is made.
    """
    key, keep = uuid.uuid4(), [c for c in features.columns if c not in ("sim_x", "wem_x")]

    def matrix(column, size):
        if column.null_count or not pc.all(pc.equal(pc.list_value_length(column), size)).as_py():
            raise ValueError(f"features of another length than {size}")
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def run(batches):
        f = ModelCache.get(key)
        if not f:
            ModelCache.add(key, f := model_factory())
        for batch in batches:
            part = None
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                p = np.asarray(f(matrix(part["sim_x"], sim_size), matrix(part["wem_x"], wem_size)), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, *[pa.array(x) for x in p.T]], [*keep, *LABELS])
            del batch, part  # the next one is read before this name is bound again

    kinds = [f"`{c}` {features.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` float" for c in LABELS]
    return features.select(*keep, "sim_x", "wem_x").mapInArrow(run, ", ".join(kinds))


def several_candidates(pairs: DataFrame) -> DataFrame:
    """Pairs of targets with more than one candidate; others yield no result."""
    n = pairs.groupBy("target").agg(F.count("*").alias("_n")).where("_n > 1").select("target")
    return pairs.join(n, "target", "left_semi")


def format_scores(predictions: DataFrame, meta: DataFrame) -> DataFrame:
    """Guess, relatedness and candidate metadata for ``(target, candidate, p_...)``."""
    fields = [f for f in DEFAULT_FIELDS if f != "htid"]
    scored = complete(predictions).withColumns({"guess": guess(), "relatedness": relatedness()})
    m = meta.select(F.col("htid").alias("candidate"), *fields)
    out = scored.join(m, "candidate")
    casts = {c: F.col(c).cast("float") for c in [*LABELS, "relatedness"]}
    casts["rights_date_used"] = F.col("rights_date_used").cast("long")
    return out.withColumns(casts).select("target", "candidate", *LABELS, "guess", *fields, "relatedness")


def zscore_profile(df: DataFrame, cluster: str, cols) -> DataFrame:
    """Mean z-score of every column per cluster; the global moments are a scalar subquery."""
    moments = df.agg(F.struct(
        *[F.avg(c).alias("m_" + c) for c in cols], *[F.stddev_pop(c).alias("s_" + c) for c in cols]).alias("m")).scalar()
    z = df.withColumn("_m", moments)
    return z.groupBy(cluster).agg(*[
        F.avg(F.try_divide(F.col(c) - F.col("_m.m_" + c), F.col("_m.s_" + c))).alias("z_" + c) for c in cols])


def group_features(df: DataFrame, cols, k=8, dims=4, seed=1234) -> DataFrame:
    """Unsupervised groups of pair features: scaling, PCA, k-means."""
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        PCA(k=min(dims, len(cols)), inputCol="_scaled", outputCol="_pca"),
        KMeans(k=k, seed=seed, featuresCol="_pca", predictionCol="cluster"),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_raw", "_scaled", "_pca")
