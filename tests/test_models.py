"""Models on separable rows: quality, save and load, missing features, choice by validation."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from floodspark.operators import metrics as M
from floodspark.operators import models as MD
from floodspark.plans.pipelines import training_report_json

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, int(a + b + rng.gauss(0, 0.3) > 1.2), a, b, None if i % 50 == 0 else rng.random(), i % 4))
    d = spark.createDataFrame(rows, "id long, y int, a double, b double, c double, part int").repartition(3).cache()
    return d.filter("part < 2"), d.filter("part = 2"), d.filter("part = 3")


def test_settings_are_the_full_ones(spark):
    e = MD.estimators()
    assert [e[k].getNumTrees() for k in ("random_forest", "extra_trees")] == [100, 100]
    assert [e[k].getMaxIter() for k in ("gradient_boosting", "boosted_weighted")] == [100, 100]


def test_forest_statistics_leave_room_in_an_executor():
    assert MD.estimators()["random_forest"].getMaxMemoryInMB() <= 256      # held once per running task


def test_forest_keeps_its_places_between_passes_and_its_trees(parts):
    forest = MD.estimators()["random_forest"]
    assert forest.getCacheNodeIds()                                        # else every pass walks every row down every tree
    rows = MD.prepare(parts[0], FEATURES)[1].cache()
    small = forest.copy({forest.numTrees: 12})
    kept, walked = (small.copy({small.cacheNodeIds: c}).fit(rows) for c in (True, False))
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in walked.trees]
    assert kept.totalNumNodes > 300


def test_penalty_follows_the_row_count(parts):
    model = MD.fit(parts[0], FEATURES, MD.estimators()["logistic_regression"])
    assert model.stages[-1].getRegParam() == pytest.approx(1 / parts[0].count())


def test_save_load_and_missing_feature(spark, parts, tmp_path):
    train, _, test = parts
    model = MD.fit(train, FEATURES, MD.estimators()["decision_tree"])
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert sorted(MD.score(model, test, FEATURES).collect()) == sorted(MD.score(again, test, FEATURES).collect())
    without = MD.score(again, test.drop("c"), FEATURES).collect()
    assert sorted(without) == sorted(MD.score(again, test.withColumn("c", F.lit(0.0)), FEATURES).collect())


def test_best_model_is_chosen_on_validation(parts):
    train, valid, test = parts
    models = {k: v for k, v in MD.estimators().items() if k in ("logistic_regression", "decision_tree")}
    report = MD.train_and_evaluate(train, valid, test, FEATURES, models=models).cache()
    rows = report.collect()
    assert [r.model for r in rows] == list(models) and all(r.test_selection_score > 0.5 for r in rows)
    for r in rows:
        model = MD.fit(train, FEATURES, models[r.model])
        for part, column in ((valid, "selection_score"), (test, "test_selection_score")):
            scored = MD.score(model, part, FEATURES).withColumn("pred", (F.col("score") >= r.threshold).cast("int"))
            assert r[column] == pytest.approx(M.binary_metrics(scored).first()["selection_score"])
    best = max(rows, key=lambda r: (r.selection_score, -r.ordinal)).model
    assert f'"best_model":"{best}"' in training_report_json(report).first()["json"]


def test_resampling_happens_at_fit_time_only(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from floodspark.operators.resample import Resampler
    rng = random.Random(1)
    d = spark.createDataFrame([(i, int(i % 10 == 0), rng.gauss(3 * (i % 10 == 0), 1), rng.gauss(0, 1)) for i in range(400)], "id long, y int, a double, b double")
    tree = MD.DecisionTreeClassifier(labelCol="y", maxDepth=3)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), Resampler(strategy="smote"), tree]).fit(d)
    assert model.stages[-1]._call_java("toDebugString")
    assert model.transform(d.filter("id < 50")).count() == 50              # other rows pass unchanged
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert again.transform(d).count() == 400 and "synthetic" not in again.transform(d).columns
    before, rows = MD.prepare(d, ["a", "b"], strategy="smote")
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    assert n == {0: 360, 1: 360} and before.transform(d).count() == 400


def test_prediction_failures_and_small_tree(parts):
    model = MD.fit(parts[0], FEATURES, MD.estimators()["decision_tree"])
    rows = MD.predict(model, parts[1], FEATURES, 0.35).collect()
    bad = {r.id for r in parts[1].filter("c IS NULL").collect()}
    assert bad and {r.id for r in rows if r.failed} == bad
    assert {(r.probability, r.prediction, r.threshold, r.alert_level, r.confidence) for r in rows if r.failed} == {(0.0, 0, 0.5, 0, 0.0)}
    assert all(r.prediction == (r.probability >= 0.35) and r.confidence == pytest.approx(2 * abs(r.probability - 0.5)) for r in rows if not r.failed)
    assert len(MD.predict(model, parts[1].drop("c"), FEATURES, 0.35).filter("failed").collect()) == 0
    assert [MD.small_tree_for(m).getMaxDepth() for m in ("random_forest", "extra_trees", "gradient_boosting")] == [8, 8, 6]
