from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimsieve.functions import text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Read https://a.b/c?d=1 NOW, @bob #x: 42 cats_and Ünits!", ["read", "now", "cats_and", "ünits"]),
        ("xxwww.y.z end", ["xx", "end"]),
        ("123 !!!", []),
        ("", []),
        (None, []),
        ("a b c", ["a", "b", "c"]),
    ],
)
def test_raw_tokens(spark, value, expected):
    assert one(spark, value, text.raw_tokens) == expected


def test_one_split_equals_the_separate_substitutions(spark):
    value = "One-two 3four, x²y ½ a_b @c#d http://e f…g"
    steps = text.remove_punct_digits(text.remove_mentions(text.remove_urls(F.lower("v"))))
    df = spark.createDataFrame([(value,)], "v string").select(steps.alias("s"), text.raw_tokens(F.col("v")).alias("t"))
    row = df.first()
    assert row["s"].split() == row["t"]


def test_stopwords_keep_order_and_repeats(spark):
    words = F.array(*[F.lit(w) for w in ("cat", "the", "cat")])
    assert one(spark, "", lambda _: text.drop_stopwords(words, ("the",))) == ["cat", "cat"]


def test_short_tokens_and_stopwords_are_dropped(spark):
    assert one(spark, "The breaking ox ate hay", text.tokens) == ["ate", "hay"]


@pytest.mark.parametrize(("value", "expected"), [(" Mostly-True ", 1), ("FALSE", 0), (None, 0), ("true\t", 1)])
def test_binarize_label(spark, value, expected):
    assert one(spark, value, text.binarize_label) == expected


@pytest.mark.parametrize(("value", "expected"), [("NA", None), ("None", None), ("none", "none"), ("", None)])
def test_normalize_missing(spark, value, expected):
    assert one(spark, value, text.normalize_missing) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("One two. One three four!", (2.5, 4.0, 0.8)),
        ("...", (0.0, 0.0, 0.0)),
        ("", (0.0, 0.0, 0.0)),
        (None, (0.0, 0.0, 0.0)),
    ],
)
def test_readability(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert tuple(df.select(*text.readability(F.col("v")).values()).first()) == expected
