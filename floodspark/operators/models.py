"""Spark ML classifiers, batch scoring, threshold tuning and the training run.

Feature vectors are assembled only at fit / score time; rows are keyed by an id, never by
position. Class balance enters as a weight column (n / (2 n_class))."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import Imputer, RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import rules as R
from ..session import cut
from . import metrics as M
from .extra_trees import ExtraTreesClassifier
from .resample import Resampler

WEIGHT = "_w"
ROWS_PER_TASK = 500_000                   # of a frame that is fitted on


def with_balanced_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """weight = n / (2 n_class) per row (class counts as scalar subqueries)."""
    n = df.agg(F.count(F.lit(1)).alias("v")).scalar()
    n1 = df.agg(F.count_if(F.col(y) == 1).alias("v")).scalar()
    n0 = df.agg(F.count_if(F.col(y) != 1).alias("v")).scalar()
    return df.withColumn(WEIGHT, F.when(F.col(y) == 1, n / (n1 * 2.0)).otherwise(n / (n0 * 2.0)))


def estimators(y: str = "y") -> dict:
    """The model families of the original training run, with their settings. Class weights come from
    ``with_balanced_weight``; the penalty of the logistic regression is set by ``fit``. The forest keeps the node of every (row, tree)
    between its passes: the same trees, but no pass ships them or walks the rows down from their roots again."""
    trees = 100
    return {
        "random_forest": RandomForestClassifier(labelCol=y, featuresCol="features", weightCol=WEIGHT,
                                                numTrees=trees, maxDepth=15, minInstancesPerNode=5,
                                                featureSubsetStrategy="sqrt", seed=P.SEED, maxMemoryInMB=256,
                                                cacheNodeIds=True, checkpointInterval=10),
        "extra_trees": ExtraTreesClassifier(labelCol=y, featuresCol="features", numTrees=trees, maxDepth=15, minSplit=10,
                                            minInstancesPerNode=5, seed=P.SEED),
        "gradient_boosting": GBTClassifier(labelCol=y, featuresCol="features", maxIter=trees, maxDepth=6,
                                           stepSize=0.1, subsamplingRate=0.8, seed=P.SEED),
        "logistic_regression": LogisticRegression(labelCol=y, featuresCol="features", weightCol=WEIGHT,
                                                  maxIter=1000, standardization=False),
        "decision_tree": DecisionTreeClassifier(labelCol=y, featuresCol="features", weightCol=WEIGHT,
                                                maxDepth=10, minInstancesPerNode=10, seed=P.SEED),
        "boosted_weighted": GBTClassifier(labelCol=y, featuresCol="features", weightCol=WEIGHT,
                                          maxIter=trees, maxDepth=6, stepSize=0.1, seed=P.SEED),
    }


def small_tree(y: str = "y", depth: int = 8) -> DecisionTreeClassifier:
    """The compact tree for the device (depth 8 after a forest wins, else 6)."""
    return DecisionTreeClassifier(labelCol=y, featuresCol="features", weightCol=WEIGHT, maxDepth=depth, seed=P.SEED)


def preparation(features: Sequence[str], scale: bool = True) -> list:
    """Stages: impute medians (fitted on train) -> assemble -> robust scale."""
    imp = Imputer(inputCols=list(features), outputCols=[f"_i_{c}" for c in features], strategy="median")
    asm = VectorAssembler(inputCols=[f"_i_{c}" for c in features], outputCol="_raw" if scale else "features",
                          handleInvalid="keep")
    stages = [imp, asm]
    if scale:
        stages.append(RobustScaler(inputCol="_raw", outputCol="features", withCentering=True, withScaling=True))
    return stages


def pipeline(features: Sequence[str], estimator, scale: bool = True) -> Pipeline:
    return Pipeline(stages=preparation(features, scale) + [estimator])


def penalised(estimator, rows: int):
    """A logistic regression is penalised by 1 / sum of weights (the balanced weights sum to the number
    of rows), so the penalty weighs alike at every size; other estimators stay as they are."""
    if isinstance(estimator, LogisticRegression):
        return estimator.copy({estimator.regParam: 1.0 / max(rows, 1)})
    return estimator


def fit(train: DataFrame, features: Sequence[str], estimator, y: str = "y") -> PipelineModel:
    """Fit a pipeline on balanced weights."""
    if isinstance(estimator, LogisticRegression):
        estimator = penalised(estimator, train.count())
    return pipeline(features, estimator).fit(with_balanced_weight(train, y))


def prepare(train: DataFrame, features: Sequence[str], y: str = "y", strategy: str = "none", id_col: str = "id") -> tuple[PipelineModel, DataFrame]:
    """The fitted stages before a classifier, balancing by ``strategy`` among them, and the rows a classifier learns
    from (features, label, weight; written once, one task per core or more)."""
    stages = preparation(features) + [Resampler(featuresCol="features", labelCol=y, idCol=id_col, strategy=strategy, seed=P.SEED)]
    model, frame = [], train
    for stage in stages:
        model.append(stage.fit(frame) if isinstance(stage, Estimator) else stage)
        frame = model[-1].transform(frame)
    width = max(train.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // ROWS_PER_TASK))
    rows = cut(with_balanced_weight(frame.select(id_col, "features", y), y).repartition(width, id_col))
    model[-1].release()
    return PipelineModel(model), rows


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("id", "y")) -> DataFrame:
    """Probability of class 1; features the model knows but the frame lacks are filled with 0.0."""
    d = df
    for c in features:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(0.0))
    out = model.transform(d)
    return out.select(*[c for c in keep if c in out.columns],
                      vector_to_array("probability").getItem(1).alias("score"))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], threshold: float, keep: Sequence[str] = ("id",)) -> DataFrame:
    """``keep`` and probability, prediction, threshold, alert_level, confidence, failed of every row.

    A feature that the frame lacks counts as 0. A row with a NULL, NaN or infinite feature cannot be predicted: it is given
    out with ``failed``, probability 0, prediction 0, threshold 0.5, alert level 0 and confidence 0."""
    usable = F.lit(True)
    for c in features:
        if c in df.columns:
            x = F.col(c).cast("double")
            usable = usable & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    d = score(model, df.withColumn("_usable", usable), features, [*keep, "_usable"])
    p = F.when(F.col("_usable"), F.col("score")).otherwise(0.0)
    d = d.select(*keep, "_usable", p.alias("probability"))
    hit = F.col("_usable") & (F.col("probability") >= threshold)
    return d.select(*keep, "probability", hit.cast("int").alias("prediction"), F.when(F.col("_usable"), F.lit(float(threshold))).otherwise(0.5).alias("threshold"),
                    F.when(F.col("_usable"), R.alert_level("probability")).otherwise(0).cast("int").alias("alert_level"),
                    F.when(F.col("_usable"), F.abs(F.col("probability") - 0.5) * 2).otherwise(0.0).alias("confidence"), (~F.col("_usable")).alias("failed"))


FITS_AT_ONCE = 3


def train_and_evaluate(train: DataFrame, valid: DataFrame, test: DataFrame, features: Sequence[str],
                       y: str = "y", models: dict | None = None, strategy: str = "none", id_col: str = "id") -> DataFrame:
    """Prepare the training rows once (balanced by ``strategy``), fit every model on them, ``FITS_AT_ONCE`` at a time (an engine
    error ends the run), and tune its threshold on validation. One row per
    model: test metrics at that threshold, ROC AUC and average precision on test, and ``selection_score``, by which the best model is chosen,
    from the validation rows; ``test_selection_score`` is the same score on the test rows."""
    before, rows = prepare(train, features, y, strategy, id_col)
    n = rows.count()

    def report(ordinal: int, name: str, est) -> DataFrame:
        model = PipelineModel([*before.stages, penalised(est, n).fit(rows)])
        on_valid = cut(score(model, valid, features))
        thr = M.tuned_threshold(on_valid).first()["threshold"]
        at = (F.col("score") >= thr).cast("int")
        chosen_by = M.binary_metrics(on_valid.withColumn("pred", at)).select("selection_score").scalar()
        on_test = cut(score(model, test, features))
        r = M.binary_metrics(on_test.withColumn("pred", at))
        return cut(r.withColumnRenamed("selection_score", "test_selection_score").select(
            F.lit(ordinal).alias("ordinal"), F.lit(name).alias("model"), F.lit(thr).alias("threshold"), "*",
            chosen_by.alias("selection_score"), M.roc_auc(on_test).scalar().alias("roc_auc"),
            M.average_precision(on_test).scalar().alias("average_precision")))
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        jobs = [pool.submit(report, k, name, est) for k, (name, est) in enumerate((models or estimators(y)).items(), start=1)]
        parts = [j.result() for j in jobs]
    return reduce(DataFrame.unionByName, parts)


def small_tree_for(best: str, y: str = "y") -> DecisionTreeClassifier:
    """The device's tree after the best model: depth 8 and leaves of 5 rows after a forest, else depth 6 and leaves of 8."""
    forest = best in ("random_forest", "extra_trees")
    return DecisionTreeClassifier(labelCol=y, featuresCol="features", weightCol=WEIGHT, maxDepth=8 if forest else 6,
                                  minInstancesPerNode=5 if forest else 8, seed=P.SEED)
