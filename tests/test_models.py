from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimsieve.operators import features, metrics, svm
from claimsieve.operators.layout import spread
from claimsieve.plans import feature_build, run, search
from claimsieve.plans.feature_build import FeatureSpec

SCHEMA = "doc_id long, label int, fold int, indices array<int>, values array<double>"


def separable(spark, n=600, width=40, per_row=12):
    rng = np.random.RandomState(3)
    direction = rng.normal(size=width)
    rows = []
    for i in range(n):
        index = np.sort(rng.choice(width, per_row, replace=False))
        value = np.abs(rng.normal(size=per_row))
        value /= np.linalg.norm(value)
        rows.append((i, int(value @ direction[index] > 0), i % 3, index.tolist(), value.tolist()))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "label", "fold", "indices", "values"]), SCHEMA)


@pytest.fixture(scope="module")
def data(spark):
    rows = separable(spark).persist()
    return rows, svm.prepare(rows, 40)


def accuracy(counts, **where):
    row = metrics.metrics(counts)
    for name, value in where.items():
        row = row.filter(F.col(name) == value)
    return row.first()["accuracy"]


def test_batched_trainer_matches_spark_ml(data):
    rows, laid_out = data
    plan = svm.TrainingPlan(passes=20)
    counts = svm.score_counts(laid_out.df, svm.fit_models(laid_out, [svm.Candidate(0)], [0, 1, 2], plan))
    train = features.to_vectors(rows.filter("fold <> 0"), 40).persist()
    test = features.to_vectors(rows.filter("fold = 0"), 40)
    model = svm.linear_svc(1.0, train.count()).fit(train)
    theirs = model.transform(test).select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert accuracy(counts, fold=0) == pytest.approx(theirs, abs=0.02)


def test_models_do_not_depend_on_tasks_and_reach_spark_ml(spark):
    rows = separable(spark, n=40_000).persist()
    plan, found = svm.TrainingPlan(passes=20), []
    for shards in (1, 8, 80):
        laid_out = svm.prepare(rows, 40, shards=shards)
        models = svm.fit_models(laid_out, [svm.Candidate(0)], [0], plan)
        predicted = svm.predict_rows(rows, models).select("doc_id", "prediction")
        found.append(dict(map(tuple, predicted.collect())))
        weights = models[0].weights[0]
        assert shards == 1 or np.allclose(weights, first, rtol=1e-6, atol=1e-8)
        first = weights
        counts = svm.score_counts(laid_out.df, models)
        ours = accuracy(counts)
        laid_out.release()
    assert found[0] == found[1] == found[2]
    train = features.to_vectors(rows.filter("fold <> 0"), 40).persist()
    theirs = svm.linear_svc(1.0, train.count()).fit(train).transform(features.to_vectors(rows.filter("fold = 0"), 40))
    assert ours >= theirs.select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] - 0.01


def test_planning_a_spread_starts_no_job(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") * 2)
    joined = rows.join(rows.withColumnRenamed("v", "w").hint("merge"), "id")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    spread(joined, "id")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(before)


def test_masked_genes_have_no_weight_and_groups_change_nothing(data, monkeypatch):
    _, laid_out = data
    tried = [svm.Candidate(0, genes=tuple(range(20))), svm.Candidate(1), svm.Candidate(2, genes=tuple(range(20)))]
    plan = svm.TrainingPlan(passes=2)
    apart = svm.fit_models(laid_out, tried, [0, 1, 2], plan)
    assert len(apart) == 3  # one shard, eight cores: one group per candidate
    first, _, third = (models.weights[0][0] for models in apart)
    assert np.abs(first[20:40]).max() == 0 and np.abs(first[:20]).max() > 0
    assert np.allclose(first, third)  # equal candidates, equal models
    many_shards = dataclasses.replace(laid_out, shards=8)
    together = svm.fit_models(many_shards, tried, [0, 1, 2], plan)
    assert len(together) == 1
    one = {(r["ind"], r["fold"]): r["tp"] for r in svm.score_counts(laid_out.df, together).collect()}
    assert one == {(r["ind"], r["fold"]): r["tp"] for r in svm.score_counts(laid_out.df, apart).collect()}
    monkeypatch.setattr(svm, "STATE_BYTES", 1)
    assert len(svm.fit_models(many_shards, tried, [0, 1, 2], plan)) == 3


def test_counts_agree_with_row_predictions(data):
    _, laid_out = data
    tried = [svm.Candidate(0), svm.Candidate(1, 1.0, "rbf", 0.5)]
    models = svm.fit_models(laid_out, tried, [0, 1, 2], svm.TrainingPlan(passes=4))
    rows = svm.predict_rows(laid_out.df, models)
    assert rows.groupBy("ind", "doc_id").count().filter("count <> 1").count() == 0
    by_row = metrics.confusion(rows, ["ind", "fold"]).orderBy("ind", "fold").collect()
    assert by_row == svm.score_counts(laid_out.df, models).orderBy("ind", "fold").collect()


def test_fourier_features_approach_the_kernel(spark, data):
    rows, _ = data
    some = rows.orderBy("doc_id").limit(30)
    waves = {r["doc_id"]: np.array(r["values"]) for r in svm.fourier_features(some, 40, 0.7, 4096).collect()}
    dense = {}
    for r in some.collect():
        dense[r["doc_id"]] = np.zeros(40)
        dense[r["doc_id"]][r["indices"]] = r["values"]
    for a in range(0, 30, 7):
        for b in range(30):
            exact = np.exp(-0.7 * np.sum((dense[a] - dense[b]) ** 2))
            assert waves[a] @ waves[b] == pytest.approx(exact, abs=0.08)


def test_probability_rises_with_the_margin(data):
    _, laid_out = data
    margins = svm.predict_rows(laid_out.df, svm.fit_models(laid_out, [svm.Candidate(0)], [0, 1, 2])).cache()
    scored = svm.with_probability(margins, svm.platt_scaler(margins)).orderBy("margin").toPandas()
    assert scored["probability"].is_monotonic_increasing
    assert scored["probability"].between(0, 1).all()


def test_searches_are_repeatable_and_improve(data):
    _, laid_out = data
    training = svm.TrainingPlan(passes=3, fourier=64)
    small = search.SubsetSearch(population=6, generations=3, training=training)
    genes, log = search.subset_search(laid_out, small)
    again, log2 = search.subset_search(laid_out, small)
    assert sorted(map(tuple, log.collect())) == sorted(map(tuple, log2.collect()))
    assert sorted(genes.collect()) == sorted(again.collect()) and genes.count() >= 5
    assert log.groupBy("generation").count().filter("count <> 6").count() == 0
    history, _ = search.setting_search(laid_out, search.SettingSearch(population=6, generations=3, training=training))
    best = [r["fitness"] for r in history.orderBy("generation").collect()]
    assert best == sorted(best) and len(best) == 3


class Killed(Exception):
    pass


@pytest.mark.parametrize("torn", [True])
def test_stopped_searches_go_on(data, tmp_path, monkeypatch, torn):
    """Stopped after its first generation, with a part of the second one written."""
    _, laid_out = data
    training = svm.TrainingPlan(passes=2, fourier=16)
    cases = [
        (search.subset_search, search.SubsetSearch(population=4, generations=3, training=training)),
        (search.setting_search, search.SettingSearch(population=4, generations=3, training=training)),
    ]
    write, fit = search.GenerationLog.write, svm.fit_models
    for find, settings in cases:
        folder = str(tmp_path / find.__name__)

        def stopping(self, generation, scored):
            if generation == 1:
                if torn:
                    scored.limit(1).write.parquet(f"{self.folder}/generation-1")
                raise Killed
            write(self, generation, scored)

        monkeypatch.setattr(search.GenerationLog, "write", stopping)
        with pytest.raises(Killed):
            find(laid_out, settings, folder=folder)
        monkeypatch.setattr(search.GenerationLog, "write", write)
        trainings = []
        monkeypatch.setattr(svm, "fit_models", lambda *a: (trainings.append(1), fit(*a))[1])
        resumed = find(laid_out, settings, folder=folder)
        assert len(trainings) <= 2
        again = find(laid_out, settings, folder=folder)
        assert len(trainings) <= 2  # a complete search trains nothing
        monkeypatch.setattr(svm, "fit_models", fit)
        whole = find(laid_out, settings)
        for table, other, same in zip(resumed, again, whole, strict=True):
            assert sorted(map(tuple, table.collect())) == sorted(map(tuple, other.collect())) == sorted(map(tuple, same.collect()))
        with pytest.raises(ValueError):
            find(laid_out, dataclasses.replace(settings, seed=1), folder=folder)


def statements(spark, n=60):
    rows = [
        (i, f"claim {'taxes rise' if i % 2 else 'rivers flow'} number {'one' if i % 3 else 'two'} again", f"p{i % 4}", float(i), i % 2)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, party string, count double, label int")


def test_saved_features_transform_alike(spark, tmp_path):
    spec = FeatureSpec(categorical=("party",), numeric=("count",), max_categories=3)
    df = statements(spark)
    model = feature_build.fit(df, spec)
    model.save(str(tmp_path / "m"))
    loaded = feature_build.load_model(spark, str(tmp_path / "m"), spec)
    order = ["doc_id", "block", "feature"]
    assert model.transform(df).orderBy(order).collect() == loaded.transform(df).orderBy(order).collect()


def test_packed_rows_equal_the_long_features(spark):
    spec = FeatureSpec(categorical=("party",), numeric=("count",), max_categories=3)
    df = statements(spark)
    tokens = feature_build.token_table(df, spec)
    model = feature_build.fit(df, spec, tokens)
    index = model.index()
    long = features.pack_rows(model.transform(df, tokens, True), index).orderBy("doc_id").collect()
    short = model.pack(df, tokens, index, True).orderBy("doc_id").collect()
    assert [r["indices"] for r in long] == [r["indices"] for r in short]
    for a, b in zip(long, short, strict=True):
        assert a["values"] == pytest.approx(b["values"])


@pytest.mark.parametrize("cap", [2, 10])
def test_packing_inside_the_row(spark, cap):
    """New categories, missing values and vectors; nothing is shuffled if the tokens carry the columns."""
    spec = FeatureSpec(categorical=("party", "state"), numeric=("count", "n"), max_categories=cap, embedding="vector", readability="raw", stem=False)
    rows = [
        (i, f"the tax plan number{i % 7} helps people {'again ' * (i % 3)}", ["a", "b", "c", "d", None][i % 5], "xy"[i % 2], [i, None][i % 9 == 0], i % 4,
         None if i % 6 == 0 else [float(i), 0.5 * i * i, 3.0, None if i == 7 else 1.0 / (1 + i)])
        for i in range(40)
    ]
    schema = "doc_id long, text string, party string, state string, count long, n int, vector array<double>"
    new = [(100, "tax", "never seen", None, None, None, None), (101, None, "a", "x", 3, 2, [1.0, 2.0, 3.0, 4.0])]
    df, fitted = spark.createDataFrame(rows + new, schema), spark.createDataFrame(rows, schema)
    model = feature_build.fit(fitted, spec)
    index = model.index()
    tokens = feature_build.token_table(df, spec, keep=spec.other_columns())
    packed = model.pack(df, tokens.repartition(1), index)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan
    long = features.pack_rows(model.transform(df, tokens), index)
    want = {r["doc_id"]: dict(zip(r["indices"], r["values"], strict=True)) for r in long.collect()}
    joined = {r["doc_id"]: r for r in model.pack_joined(df, tokens, index).collect()}
    got = {r["doc_id"]: r for r in packed.collect()}
    plain = {r["doc_id"]: r for r in model.pack(df, tokens.select("doc_id", "tokens"), index).collect()}
    assert set(got) == set(joined) == set(plain) == {r["doc_id"] for r in df.collect()}
    for key, r in got.items():
        assert r["indices"] == sorted(r["indices"]) == joined[key]["indices"] == plain[key]["indices"]
        assert dict(zip(r["indices"], r["values"], strict=True)) == pytest.approx(want.get(key, {}))


def test_whole_run_writes_everything(spark, tmp_path):
    training = svm.TrainingPlan(passes=4, fourier=64)
    options = run.RunSettings(
        FeatureSpec(categorical=("party",), numeric=("count",)),
        search.SubsetSearch(population=5, generations=2, training=training),
        search.SettingSearch(population=4, generations=2, training=training),
        training,
        run_id="r1",
    )
    out = run.run(statements(spark), options, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/predictions")).count() == 12
    result = spark.read.json(str(tmp_path / "out/result")).first()
    assert result["run_id"] == "r1" and result["dataset"]["total_samples"] == 60
    assert result["performance"]["accuracy"] >= 0.9  # the words give the label away
    report = {(r["section"], r["metric"]): r["value"] for r in out.report.collect()}
    assert report[("5 performance", "n_rows")] == "12"
    assert spark.read.option("header", True).csv(str(tmp_path / "out/report")).count() == len(report)
    reloaded = run.load_scorer(spark, str(tmp_path / "out"), options.spec)
    test_rows = statements(spark).join(out.predictions.select("doc_id"), "doc_id", "left_semi")
    again = {r["doc_id"]: r["probability"] for r in reloaded.score(test_rows).collect()}
    assert again == pytest.approx({r["doc_id"]: r["probability"] for r in out.predictions.collect()})


def test_sparse_products_equal_dense_ones(monkeypatch):
    draw = np.random.RandomState(5)
    dense = np.where(draw.rand(30, 50) < 0.2, draw.normal(size=(30, 50)), 0.0)
    dense[[0, 7, 29]] = 0.0  # rows without entries
    rows, columns = np.nonzero(dense)
    block = svm._Block(columns, dense[rows, columns], np.cumsum((dense != 0).sum(axis=1)), 50)
    whole = np.concatenate([dense, np.ones((30, 1))], axis=1)
    weights, pull = draw.normal(size=(51, 4)), draw.normal(size=(30, 4))
    for entries in (1, 40, 1 << 19):
        monkeypatch.setattr(svm, "ENTRIES", entries)
        assert np.allclose(block.times(weights), whole @ weights)
        slopes = np.zeros((51, 4))
        block.add_gradient(slopes, pull)
        assert np.allclose(slopes, -(whole.T @ pull))
