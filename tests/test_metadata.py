from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimsieve.operators import metadata, vectors


def categories(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, c string")


def fitted(df, cap):
    seen = metadata.category_counts(df, ["c"], "doc_id")
    return metadata.frequent_categories(seen, cap), seen.select("column", "category")


def test_cap_keeps_one_less_and_a_shared_output(spark):
    values = [f"v{i:02}" for i in range(51) for _ in range(i + 1)]
    top, _ = fitted(categories(spark, values), 50)
    rows = top.orderBy("pos").collect()
    assert len(rows) == 50
    assert rows[-1]["is_infrequent"] and rows[-1]["n"] == 1 + 2
    assert [r["category"] for r in rows[:-1]] == [f"v{i:02}" for i in range(2, 51)]


def test_ties_keep_the_later_category_and_null_is_last(spark):
    top, _ = fitted(categories(spark, ["a", "b", "c", None]), 3)
    assert [(r["category"], r["out_name"]) for r in top.orderBy("pos").collect()] == [
        ("c", "c=c"),
        (None, "c=<null>"),
        (None, "c=<infrequent>"),
    ]


def test_unknown_gives_no_entry_and_rare_gives_the_shared_one(spark):
    top, known = fitted(categories(spark, ["a", "a", "a", "b", "b", "x", "y", None, None, None, None]), 3)
    df = categories(spark, ["a", "x", "y", "b", "new", None])
    got = metadata.onehot(df, top, ["c"], "doc_id", 3, known)
    assert sorted((r["doc_id"], r["feature"], r["value"]) for r in got.collect()) == [
        (0, "c=a", 1.0),
        (1, "c=<infrequent>", 1.0),
        (2, "c=<infrequent>", 1.0),
        (3, "c=<infrequent>", 1.0),
        (5, "c=<null>", 1.0),
    ]


@pytest.mark.parametrize(
    ("values", "expected"), [([2.0, 2.0], [0.0, 0.0]), ([1.0, None, 3.0], [-1.0, 0.0, 1.0])]
)
def test_zscore(spark, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, x double")
    got = metadata.zscore(df, metadata.numeric_stats(df, ["x"]), ["x"], "doc_id").orderBy("doc_id")
    assert [r["value"] for r in got.collect()] == pytest.approx(expected, abs=1e-7)


def test_standardize_constant_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "doc_id bigint, v array<float>")
    got = vectors.standardize(df, vectors.vector_stats(df, "v"), "doc_id", "v")
    rows = {(r["doc_id"], r["pos"]): r["value"] for r in got.collect()}
    assert rows == {(1, 0): -1.0, (1, 1): 0.0, (2, 0): 1.0, (2, 1): 0.0}


def test_rank_filter_runs_before_the_shuffle(spark):
    top, _ = fitted(categories(spark, ["a"]), 5)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "g int, v array<double>")
    got = vectors.mean_pool(df, "g", "v").orderBy("g", "pos").select(F.col("value"))
    assert [r["value"] for r in got.collect()] == [2.0, 3.0, 5.0, 6.0]
