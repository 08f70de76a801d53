"""The default models of each problem type, as Spark ML stages behind a common scaler."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.common import _py2java
from pyspark.ml.feature import RobustScaler, RobustScalerModel, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from caseloom.operators.metrics import classification_metrics
from caseloom.plans.boosting import SoftmaxBoosting
from caseloom.plans.kernels import FourierKernel, HingeMachine, InsensitiveRegression, PenaltyByRows
from caseloom.plans.summed_classes import SummedClasses
from caseloom.plans.summed_trees import SummedTrees

RAW, SCALED = "raw_features", "features"
#: Marks the rows that models are fitted on, where their number is bounded.
FIT = "__fit"
SEED = 42
CV_FOLDS = 5


class WholeRobustScaler(Estimator):
    """Robust scaling that keeps features whose interquartile range is 0: they are centred and divided by 1.

    Spark's own model writes 0 for them, which would erase rare flags and sparse text weights.
    """

    def _fit(self, dataset: DataFrame) -> RobustScalerModel:
        model = RobustScaler(inputCol=RAW, outputCol=SCALED, withCentering=True, relativeError=0.001).fit(dataset)
        context = dataset.sparkSession.sparkContext
        spans = Vectors.dense([float(r) or 1.0 for r in model.range.toArray()])
        whole = context._jvm.org.apache.spark.ml.feature.RobustScalerModel(model.uid, _py2java(context, spans), _py2java(context, model.median))
        whole.set("inputCol", RAW).set("outputCol", SCALED).set("withCentering", True)
        return RobustScalerModel(whole)


def scaler_stage(kind: str):
    if kind == "robust":
        return WholeRobustScaler()
    return StandardScaler(inputCol=RAW, outputCol=SCALED, withMean=True)


#: Spark's limit for the depth of a tree; forests are otherwise not limited.
MAX_DEPTH = 30


def classifiers(classes: int, rows: int, effort: float = 1.0, weight: str = "weight") -> dict[str, list]:
    """Stages per model.  `effort` scales iterations, trees and depth, for quick tests.

    Weights balance the classes for all but gradient boosting.
    """
    trees, boosts = max(5, round(100 * effort)), max(5, round(100 * effort))
    boosting = SummedClasses(GBTClassifier(maxIter=boosts, stepSize=0.1, maxDepth=3, seed=SEED))
    # One linear machine per class on kernel features; its margins are turned into probabilities by a
    # logistic fit (Platt).
    held = dict(featuresCol="kernel_features", weightCol=weight, regParam=1.0 / max(1, rows), maxIter=max(10, round(100 * effort)), predictionCol="svm_prediction")
    machine = HingeMachine(**held)
    if classes > 2:
        boosting = SoftmaxBoosting(classes=classes, maxIter=boosts, stepSize=0.1, maxDepth=3, seed=SEED)
        machine = OneVsRest(
            classifier=LinearSVC(standardization=False, **held), featuresCol="kernel_features", weightCol=weight, predictionCol="svm_prediction"
        )
    return {
        "Logistic Regression": [
            PenaltyByRows(LogisticRegression(weightCol=weight, standardization=False, maxIter=100))
        ],
        "Random Forest": [
            SummedClasses(RandomForestClassifier(
                weightCol=weight, numTrees=trees, maxDepth=max(5, round(MAX_DEPTH * effort)), featureSubsetStrategy="sqrt", seed=SEED,
            ))
        ],
        "Gradient Boosting": [boosting],
        "Support Vector Classifier": [
            FourierKernel(inputCol=SCALED, outputCol="kernel_features", seed=SEED),
            machine,
            LogisticRegression(
                featuresCol="rawPrediction", rawPredictionCol="calibrated", weightCol=weight, maxIter=100
            ),
        ],
    }


def regressors(effort: float = 1.0) -> dict[str, list]:
    trees, boosts = max(5, round(100 * effort)), max(5, round(100 * effort))
    return {
        "Ridge Regression": [
            PenaltyByRows(
                LinearRegression(elasticNetParam=0.0, standardization=False, solver="auto"), by_deviation=True
            )
        ],
        "Huber Regression (Robust)": [
            PenaltyByRows(LinearRegression(loss="huber", epsilon=1.35, maxIter=max(50, round(1000 * effort))), alpha=1e-4)
        ],
        "Support Vector Regressor": [
            FourierKernel(inputCol=SCALED, outputCol="kernel_features", seed=SEED),
            InsensitiveRegression(featuresCol="kernel_features", c=1.0, epsilon=0.1),
        ],
        "Random Forest (Tuned)": [
            SummedTrees(RandomForestRegressor(numTrees=trees, maxDepth=5, featureSubsetStrategy="all", seed=SEED))
        ],
        "Gradient Boosting (Tuned)": [
            SummedTrees(GBTRegressor(maxIter=boosts, stepSize=0.05, maxDepth=3, subsamplingRate=0.8, seed=SEED))
        ],
    }


def default_models(problem_type: str, rows: int, classes: int = 2, effort: float = 1.0) -> dict[str, list]:
    return classifiers(classes, rows, effort) if problem_type == "classification" else regressors(effort)


class MacroF1Evaluator(Evaluator):
    """Unweighted mean of the classes' F1."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return classification_metrics(dataset, self.label, self.prediction).first()["f1_macro"]

    def isLargerBetter(self) -> bool:
        return True


@dataclass
class Validated:
    """Mean and (population) deviation of the folds' scores, and the fit on all training rows."""

    avgMetrics: list[float]
    stdMetrics: list[float]
    bestModel: PipelineModel


def fit_pipeline(rows: DataFrame, stages: list, scaler: str) -> PipelineModel:
    """The scaler fitted on all rows, the model on those marked in FIT, or on all without such a column."""
    scaled = Pipeline(stages=[scaler_stage(scaler)]).fit(rows)
    if FIT not in rows.columns:
        return PipelineModel(stages=[*scaled.stages, *Pipeline(stages=stages).fit(scaled.transform(rows)).stages])
    # Few rows, read many times: found by all tasks and moved to one, in an order that only the rows decide.
    marked = rows.where(FIT).repartition(1).sortWithinPartitions("label", F.xxhash64(RAW))
    part = scaled.transform(marked).persist()
    fitted = Pipeline(stages=stages).fit(part)
    part.unpersist()
    return PipelineModel(stages=[*scaled.stages, *fitted.stages])


def cross_validate(
    train: DataFrame, stages: list, scaler: str, problem_type: str, folds: int = CV_FOLDS, fold: str = "fold",
    parallelism: int = CV_FOLDS + 1,
) -> Validated:
    """Fold scores and, as `bestModel`, the fit on all training rows; `parallelism` of these fits run side by side.

    Each fold fits its own scaler on its training part and is scored on all its rows; FIT bounds only the fits of models.
    """
    evaluator = MacroF1Evaluator() if problem_type == "classification" else RegressionEvaluator(metricName="r2")
    def fitted(number: int | None) -> PipelineModel | float:
        if number is None:
            return fit_pipeline(train, stages, scaler)
        return evaluator.evaluate(fit_pipeline(train.where(F.col(fold) != number), stages, scaler).transform(train.where(F.col(fold) == number)))

    with ThreadPool(max(1, parallelism)) as pool:
        best, *scores = pool.map(inheritable_thread_target(train.sparkSession)(fitted), [None, *range(folds)], chunksize=1)
    return Validated([float(np.mean(scores))], [float(np.std(scores))], best)
