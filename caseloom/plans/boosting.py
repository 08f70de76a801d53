"""Gradient boosting for any number of classes: one regression tree per class and round, on the gradients of the softmax.

All trees of a round are fitted on the same rows, whose margins were moved by the rounds before; leaves take one Newton
step.  Trees are Spark's regression trees, fitted side by side; only trees and sums per leaf reach the driver.  Rows of one
class whose features lie in the same bins have equal gradients, so trees are fitted on such groups where these are few.
"""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, Param, Params, TypeConverters,
)
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from caseloom.plans.summed_classes import grouped_rows
from caseloom.plans.summed_trees import BINNED
from caseloom.session import cut_lineage

#: Most bins of a feature that trees tell apart, as by default in Spark.
BINS = 32
#: Rounds whose trees are kept beside written margins before the margins are written anew.
WRITTEN = 10


def tree_nodes(model: DecisionTreeRegressionModel) -> list[list[float]]:
    """The nodes of a tree as [feature, threshold, left, right]; a leaf has feature -1 and its number in `left`."""
    nodes: list[list[float]] = []
    leaves = 0

    def add(node) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append([])
        if node.subtreeDepth() == 0:
            nodes[at] = [-1, 0.0, leaves, -1]
            leaves += 1
        else:
            split = node.split()
            nodes[at] = [split.featureIndex(), split.threshold(), 0, 0]
            nodes[at][2:] = [add(node.leftChild()), add(node.rightChild())]
        return at

    add(model._java_obj.rootNode())
    return nodes


def _on_values(nodes: list[list[float]], points: list[list[float]]) -> list[list[float]]:
    """The nodes of a tree over numbers of bins, for the values themselves."""
    return [[f, points[f][int(t)], *ways] if f >= 0 else [f, t, *ways] for f, t, *ways in nodes]


def leaf_numbers(nodes: list[list[float]], x: np.ndarray) -> np.ndarray:
    """The leaf of each row of `x`."""
    table = np.array(nodes)
    feature, threshold = table[:, 0].astype(int), table[:, 1]
    left, right = table[:, 2].astype(int), table[:, 3].astype(int)
    at = np.zeros(len(x), int)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return left[at]
        own = at[inner]
        at[inner] = np.where(x[inner, feature[own]] <= threshold[own], left[own], right[own])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))


def moved_margins(features: Column, margins: Column, rounds: list, rate: float) -> Column:
    """Margins moved by the trees of some rounds; `rounds` holds (nodes, leaf values) of each class."""
    @F.arrow_udf("array<double>")
    def move(rows: pa.Array, before: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], pa.list_(pa.float64()))
        x, out = _matrix(rows), _matrix(before).copy()
        for trees in rounds:
            for k, (nodes, values) in enumerate(trees):
                out[:, k] += rate * np.array(values)[leaf_numbers(nodes, x)]
        return _lists(out)

    return move(features, margins) if rounds else margins


def softmax(margins: Column) -> Column:
    shifted = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


class SoftmaxBoosting(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits `maxIter` rounds of one tree per class 0..classes-1; labels are class numbers.

    A class without rows keeps a very low margin.  Weights are not used.
    """

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree's step", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", classes=2, maxIter=100, maxDepth=3, stepSize=0.1, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", classes=2, maxIter=100, maxDepth=3, stepSize=0.1, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        classes, rate, depth, seed = (self.getOrDefault(p) for p in (self.classes, self.stepSize, self.maxDepth, self.seed))
        label, features = F.col(self.getLabelCol()).cast("int"), self.getFeaturesCol()
        groups = grouped_rows(dataset, features, label, F.lit(1.0), BINS)
        if groups is None:
            source, bins = dataset.select(F.col(features).alias("features"), label.alias("y"), F.lit(1.0).alias("n")), BINS
        else:
            source, bins = groups.table.select(F.col(BINNED).alias("features"), F.col("label").cast("int").alias("y"), F.col("n").cast("double").alias("n")), groups.bins
        counts = {r["y"]: r["n"] for r in source.groupBy("y").agg(F.sum("n").alias("n")).collect()}
        total = sum(counts.values())
        start = [float(np.log(max(counts.get(k, 0), 1e-9) / max(1, total))) for k in range(classes)]
        rows = cut_lineage(source.withColumn("margins", F.array(*[F.lit(s) for s in start])))
        rounds, recent, importance = [], [], 0.0
        for number in range(self.getOrDefault(self.maxIter) if total else 0):
            now = moved_margins(vector_to_array("features"), F.col("margins"), recent, rate)
            if len(recent) == WRITTEN:
                rows, recent = cut_lineage(rows.withColumn("margins", now)), []
                now = F.col("margins")
            gap = F.transform(softmax(F.col("now")), lambda p, k: F.when(F.col("y") == k, 1.0).otherwise(0.0) - p)
            current = rows.select("features", "y", "n", now.alias("now")).select("features", "n", gap.alias("gap")).persist(StorageLevel.MEMORY_AND_DISK)
            fitted = self._round(current, classes, depth, bins, seed + number)
            trees = [tree_nodes(model) for model in fitted]
            trees = list(zip(trees, _leaf_values(current, trees, classes)))
            current.unpersist()
            importance = importance + sum(model.featureImportances.toArray() for model in fitted)
            rounds.append(trees)
            recent.append(trees)
        share = importance / max(float(np.sum(importance)), 1e-300)
        if groups is not None:
            rounds = [[(_on_values(nodes, groups.points), values) for nodes, values in trees] for trees in rounds]
        held = {"start": start, "rate": rate, "rounds": rounds, "importance": np.atleast_1d(share).tolist()}
        return SoftmaxBoostingModel(featuresCol=self.getFeaturesCol(), trees=json.dumps(held))

    def _round(self, current: DataFrame, classes: int, depth: int, bins: int, seed: int) -> list[DecisionTreeRegressionModel]:
        def fit(k: int) -> DecisionTreeRegressionModel:
            own = current.select("features", "n", F.col("gap")[k].alias("goal"))
            return DecisionTreeRegressor(labelCol="goal", weightCol="n", maxDepth=depth, maxBins=bins, seed=seed).fit(own)

        with ThreadPool(min(8, classes)) as pool:
            return pool.map(inheritable_thread_target(current.sparkSession)(fit), range(classes), chunksize=1)


def _leaf_values(current: DataFrame, trees: list, classes: int) -> list[list[float]]:
    """The Newton step of each leaf of each class: (K - 1) / K * sum(gap) / sum(|gap| (1 - |gap|)), summed within tasks first."""
    def sums(batches):
        total = [np.zeros((2, len(t))) for t in trees]
        for batch in batches:
            x, gap, n = _matrix(batch.column(0)), _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            for k, nodes in enumerate(trees):
                leaf, size = leaf_numbers(nodes, x), np.abs(gap[:, k])
                total[k] += [np.bincount(leaf, n * v, len(nodes)) for v in (gap[:, k], size * (1 - size))]
        for k, table in enumerate(total):
            n = table.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([k] * n), pa.array(range(n)), pa.array(table[0]), pa.array(table[1])], ["k", "leaf", "gap", "curve"])

    found = current.select(vector_to_array("features").alias("x"), "gap", "n").mapInArrow(sums, "k bigint, leaf bigint, gap double, curve double")
    values = [[0.0] * len(t) for t in trees]
    for r in found.groupBy("k", "leaf").agg(F.sum("gap").alias("gap"), F.sum("curve").alias("curve")).collect():
        values[r["k"]][r["leaf"]] = (classes - 1) / classes * r["gap"] / r["curve"] if r["curve"] > 1e-150 else 0.0
    return values


class SoftmaxBoostingModel(
    Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """The trees of all rounds, as JSON, so that the model is saved like any stage."""

    trees = Param(Params._dummy(), "trees", "start, rate, rounds and importances", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction", trees="{}"):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction", trees="{}")
        self._set(**self._input_kwargs)

    @property
    def held(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.held["importance"])

    @property
    def numClasses(self) -> int:
        return len(self.held["start"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = self.held
        start = F.array(*[F.lit(s) for s in held["start"]])
        scored = dataset.withColumn("__margins", moved_margins(vector_to_array(F.col(self.getFeaturesCol())), start, held["rounds"], held["rate"]))
        chances = scored.withColumn("__chances", softmax(F.col("__margins")))
        best = (F.array_position("__margins", F.array_max("__margins")) - 1).cast("double")
        return chances.withColumns({
            self.getRawPredictionCol(): array_to_vector("__margins"), self.getProbabilityCol(): array_to_vector("__chances"), self.getPredictionCol(): best,
        }).drop("__margins", "__chances")
