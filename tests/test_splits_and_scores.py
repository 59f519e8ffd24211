from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimsieve.functions import scores
from claimsieve.functions.draws import uniform
from claimsieve.operators import metrics, ranking


def rows(spark, n=700):
    label = (F.col("id") % 3 == 0).cast("int")
    return spark.range(n).select(F.col("id").alias("doc_id"), label.alias("label"))


def test_split_sizes_and_determinism(spark):
    df = rows(spark)
    split = {r["doc_id"]: (r["label"], r["split"]) for r in ranking.stratified_split(df).collect()}
    again = ranking.stratified_split(df.repartition(3)).collect()
    assert split == {r["doc_id"]: (r["label"], r["split"]) for r in again} and len(split) == 700
    sizes = Counter(split.values())
    assert sizes[(1, "test")] == round(234 * 0.2) and sizes[(0, "test")] == round(466 * 0.2)
    assert abs(sizes[(1, "val")] - 234 * 0.2) <= 1 and abs(sizes[(0, "train")] - 466 * 0.6) <= 1


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_bucketed_rank_equals_the_plain_window(spark, buckets):
    df = rows(spark)
    plain = F.row_number().over(Window.partitionBy("label").orderBy(uniform("t", F.col("doc_id")), "doc_id"))
    expected = {r["doc_id"]: r["rank"] for r in df.withColumn("rank", plain).collect()}
    got = ranking.random_rank(df, "label", "doc_id", "t", buckets=buckets)
    assert {r["doc_id"]: r["rank"] for r in got.collect()} == expected


def test_folds_are_even_in_every_class(spark):
    sizes = ranking.stratified_folds(rows(spark)).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1


def test_no_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "label int, prediction int")
    row = metrics.metrics(metrics.confusion(df, [])).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert row["accuracy"] == pytest.approx(1 / 3)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_penalty_and_subset_fitness(spark):
    lit = F.lit
    assert value(spark, scores.complexity_penalty(lit(9), lit(100))) == pytest.approx(0.3)
    assert value(spark, scores.complexity_penalty(lit(50), lit(100))) == pytest.approx(0.3)
    assert value(spark, scores.complexity_penalty(lit(4), lit(100))) == pytest.approx(0.2)
    m = [lit(0.8)] * 4
    assert value(spark, scores.subset_fitness(*m, lit(4), lit(100))) == 0
    assert value(spark, scores.subset_fitness(*m, lit(50), lit(100))) == pytest.approx(0.635)
    nothing = [lit(None).cast("double")] * 4
    assert value(spark, scores.subset_fitness(*nothing, lit(50), lit(100))) == 0


def test_setting_fitness_and_coding(spark):
    lit = F.lit
    assert value(spark, scores.setting_fitness(lit(0.7), lit(10.0), lit(0.1))) == pytest.approx(0.69)
    assert value(spark, scores.encode_log(lit(1.0), (0.1, 10.0))) == pytest.approx(0.5)
    assert value(spark, scores.encode_log(lit(0.1), (0.001, 1.0))) == pytest.approx(2 / 3)
    assert value(spark, scores.decode_log(lit(0.5), (0.1, 10.0))) == pytest.approx(1.0)
    assert value(spark, scores.decode_log(lit(2.0), (0.1, 10.0))) == pytest.approx(10.0)
    assert value(spark, scores.decode_kernel(scores.encode_kernel(lit("rbf")))) == "rbf"


@pytest.mark.parametrize(("generation", "expected"), [(0, 0.05), (15, 0.025), (29, 0.01)])
def test_decay(spark, generation, expected):
    assert value(spark, scores.decayed(0.05, F.lit(generation), 30)) == pytest.approx(expected)
