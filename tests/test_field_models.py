"""Learned field vectors: shape, repeatability, neighbours."""

import numpy as np
from pyspark.sql import functions as F

from textkin.operators import field_models as fm

WORDS = "history river garden physics letter journey music poems botany castle island theory".split()


def meta(spark):
    rows = [(f"v{i:03}", f"{WORDS[i % 12]} of the {WORDS[(i * 5 + 1) % 12]}", f"author {i % 7}", f"v.{i % 4}" if i % 3 else None) for i in range(120)]
    rows += [("copy", rows[5][1], rows[5][2], rows[5][3]), ("near", rows[5][1] + "s", rows[5][2], rows[5][3]), ("none", None, None, None), ("blank", "", "", "")]
    return spark.createDataFrame(rows, "htid string, title string, author string, description string")


def vectors(df):
    return {r.htid: np.array(r.vec) for r in df.collect()}


def test_learned_vectors(spark, tmp_path):
    m, fields = meta(spark), fm.standard_fields()
    models = fm.fit_field_models(m, fields)
    got = vectors(fm.model_field_vectors(m, fields, models))
    assert len(got) == 124 and {len(v) for v in got.values()} == {100} and all(np.isfinite(v).all() for v in got.values())
    assert (got["copy"] == got["v005"]).all() and not got["none"].any() and not got["blank"].any()

    def nearest(x):
        u = {k: v[20:60] / np.linalg.norm(v[20:60]) for k, v in got.items() if v[20:60].any()}
        return sorted((k for k in u if k != x), key=lambda k: -float(u[x] @ u[k]))

    same = {k for k in got if k == "v005" or k.startswith("v") and m.where(F.col("htid") == k).first().title == m.where("htid = 'v005'").first().title}
    assert set(nearest("copy")[:len(same)]) == same and "near" in nearest("copy")[:len(same) + 8]

    fm.save_field_models(models, str(tmp_path))
    held = [n for n, x in models.items() if x is not None]
    again = vectors(fm.model_field_vectors(m, fields, fm.load_field_models(str(tmp_path), held)))
    refit = vectors(fm.model_field_vectors(m, fields, fm.fit_field_models(m.repartition(5), fields)))
    assert all((again[k] == got[k]).all() and np.allclose(refit[k], got[k], atol=1e-6) for k in got)


def test_fields_without_values(spark):
    m, fields = meta(spark).where("htid = 'none'"), fm.standard_fields()
    models = fm.fit_field_models(m, fields)
    assert set(models.values()) - {None} == set() or models["title_description"] is not None
    assert [len(r.vec) for r in fm.model_field_vectors(m, fields, models).collect()] == [100]
    assert fm.model_field_vectors(m.where("false"), fields, models).collect() == []
