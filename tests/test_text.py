"""Golden strings of the normalising expressions."""

import pytest
from pyspark.sql import functions as F

from textkin.functions import ids, text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    ("Poems / by J. Smith", "Poems"),
    ("Poems / edited / by J. Smith", "Poems"),
    ("a/b/c/d", "a/b"),
    ("Plain title.", "Plain title"),
    ("Essays; by A. Person", "Essays"),
    ("Essays [by] A. Person", "Essays"),
    ("Tales; illustrated by B.", "Tales"),
    ("Works. Translated from the French by X.", "Works"),
    ("Works, selected and arranged by the editor", "Works"),
    ("Memoirs, by the late John Smith.", "Memoirs"),
    ("Memoirs. By Jane Doe and others", "Memoirs"),
    ("Standby power", "Standby power"),
])
def test_clean_title(spark, raw, want):
    assert one(spark, raw, text.clean_title) == want


@pytest.mark.parametrize("raw,want", [
    ("v.001", "v.1"), ("cop.1", "c.1"), ("Pt1", "pt.1"), ("vol. 1", "v.1"), ("v. 3", "v.3"), ("12", "v.12"),
    ("copy 2", "c.2"), ("(v.1)", "v.1"), ("v.1.", "v.1"), ("c4", "c.4"), ("v.10", "v.10"),
])
def test_clean_description(spark, raw, want):
    assert one(spark, raw, text.clean_description) == want


@pytest.mark.parametrize("raw,want", [
    ("Smith, John, 1850-1901.", "Smith, John"), ("Doe, Jane", "Doe, Jane"), (" Anon. ", "Anon"), ("A, B, C, D", "A, B"),
])
def test_clean_author(spark, raw, want):
    assert one(spark, raw, text.clean_author) == want


def test_title_key_is_unicode_aware(spark):
    assert one(spark, "Œuvres complètes: tome 1 / par X", text.simple_title) == "œuvrescomplètes"
    assert len(one(spark, "x" * 80, text.simple_title)) == 35


def test_invert_name(spark):
    assert one(spark, "Mary Ann Evans", text.invert_name) == "Evans, Mary Ann"
    assert one(spark, "plato", text.invert_name) == "plato"


def test_chunk_ids_are_read_from_the_right(spark):
    df = spark.createDataFrame([("u-x.1-0003-10-12",), ("u-x.1-0003",)], "m string")
    rows = df.select(*[c.alias(n) for n, c in ids.split_chunk_id(F.col("m")).items()]).collect()
    assert tuple(rows[0]) == ("u-x.1", 3, 10, 12)
    assert tuple(rows[1]) == ("u-x.1", 3, None, None)


def test_stub(spark):
    assert one(spark, "mdp.39015012345678", ids.stub) == "31147"


def test_parse_int_list(spark):
    assert one(spark, "['1', '2']", text.parse_int_list) == [1, 2]
    assert one(spark, "[]", text.parse_int_list) == []


def test_numeric_or_null(spark):
    assert one(spark, "12", text.numeric_or_null) == 12.0
    assert one(spark, "None", text.numeric_or_null) is None
    assert one(spark, "n/a", text.numeric_or_null) is None


def test_char_ngrams(spark):
    assert one(spark, "Red ox", text.char_ngrams) == ["<re", "red", "ed>", "<red", "red>", "<ox", "ox>", "<ox>"]
