"""Support vector models on Spark: random Fourier features, epsilon-insensitive regression and the hinge loss of two classes.

The exact kernel solvers need all pairs of rows.  Here the radial kernel is approximated by random
Fourier features (Rahimi and Recht, 2007), after which linear models do the work in one pass per
iteration.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol, HasPredictionCol, HasRegParam, HasWeightCol, Param, Params, TypeConverters,
)
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

#: Tasks whose sums are added by the driver; more are added by so many tasks first.
PARTS = 64
#: Widths around a margin of 1 over which the hinge loss is rounded off, one after the other, and the steps that a round tries.
WIDTHS, STEPS = (2.0, 0.5, 0.125, 0.03125), tuple(2.0**-i for i in range(12))


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """cos(x W + b) with seeded W and b; `gamma` 0 means 1 / number of features (for scaled inputs)."""

    size = Param(Params._dummy(), "size", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=64, gamma=0.0, seed=42):
        super().__init__()
        self._setDefault(size=64, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = {"gamma": self.getOrDefault(self.gamma), "size": self.getOrDefault(self.size), "seed": self.getOrDefault(self.seed)}
        expand = _expansion(**held)

        @F.arrow_udf("array<double>")
        def project(rows: pa.Array) -> pa.Array:
            if not len(rows):
                return pa.array([], pa.list_(pa.float64()))
            values = expand(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
            return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))

        source, out = self.getInputCol(), self.getOutputCol()
        features = array_to_vector(project(vector_to_array(F.col(source)))).alias(out, metadata={"fourier": {"source": source, **held}})
        return dataset.select(*[c for c in dataset.columns if c != out], features)


def _expansion(gamma: float, size: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    drawn = {}

    # Nested, so that workers need no copy of this package.
    def expand(x: np.ndarray) -> np.ndarray:
        dims = x.shape[1]
        if dims not in drawn:
            rng = np.random.default_rng(seed)
            drawn[dims] = rng.normal(0.0, np.sqrt(2 * (gamma or 1.0 / dims)), (dims, size)), rng.uniform(0.0, 2 * np.pi, size)
        weights, shift = drawn[dims]
        values = x @ weights
        values += shift
        np.cos(values, out=values)
        values *= np.sqrt(2.0 / size)
        return values

    return expand


class FourierKernel(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the kernel width: gamma = 1 / (number of features * variance of all their values)."""

    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, seed=42):
        super().__init__()
        self._setDefault(seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FourierFeatures:
        found = dataset.select(Summarizer.metrics("mean", "normL2", "count").summary(F.col(self.getInputCol())).alias("s")).first()["s"]
        means, squares = found["mean"].toArray(), found["normL2"].toArray() ** 2 / max(1, found["count"])
        variance = float(squares.mean() - means.mean() ** 2)
        gamma = 1.0 / (len(means) * variance) if variance > 0 else 1.0
        return FourierFeatures(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), gamma=gamma, seed=self.getOrDefault(self.seed))


class PenaltyByRows(Estimator):
    """Fits `estimator` with penalty `alpha` divided by the rows of the data at hand (a fold has fewer).

    `by_deviation` makes up for least squares dividing its penalty by the label's deviation.
    """

    def __init__(self, estimator: Estimator, alpha: float = 1.0, by_deviation: bool = False):
        super().__init__()
        self.estimator, self.alpha, self.by_deviation = estimator, alpha, by_deviation

    def _fit(self, dataset: DataFrame):
        label = F.col(self.estimator.getLabelCol()).cast("double")
        rows, deviation = dataset.agg(F.count("*"), F.stddev_pop(label)).first()
        penalty = self.alpha * (deviation if self.by_deviation else 1.0) / max(1, rows)
        return self.estimator.copy({self.estimator.regParam: penalty}).fit(dataset)


class InsensitiveRegression(
    Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Linear support vector regression by reweighted least squares.

    Each round solves least squares with weights that make the squared loss touch the epsilon-insensitive one at the
    current residuals: rows inside the tube get (almost) no weight, others 1 / (distance to the tube), measured to the
    tube's edge.  A round is one pass, in which tasks add up the matrices of the normal equations.  Random Fourier
    features are not stored but made from their inputs in each pass.
    """

    c = Param(Params._dummy(), "c", "penalty of the loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half width of the tube", TypeConverters.toFloat)
    rounds = Param(Params._dummy(), "rounds", "most reweighting rounds", TypeConverters.toInt)
    tolerance = Param(Params._dummy(), "tolerance", "relative change of the coefficients that ends the rounds", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", c=1.0, epsilon=0.1, rounds=50, tolerance=1e-3):
        super().__init__()
        self._setDefault(c=1.0, epsilon=0.1, rounds=50, tolerance=1e-3)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        c, rounds = self.getOrDefault(self.c), self.getOrDefault(self.rounds)
        data, expand = _inputs(dataset, self.getFeaturesCol(), F.col(self.getLabelCol()).cast("double").alias("y"))
        many, epsilon = data.rdd.getNumPartitions() > PARTS, self.getOrDefault(self.epsilon)
        solution = _solved(data, many, expand, None, epsilon, c)
        for _ in range(rounds):
            before, solution = solution, _solved(data, many, expand, solution, epsilon, c)
            if np.linalg.norm(solution - before) <= self.getOrDefault(self.tolerance) * max(1e-12, np.linalg.norm(before)):
                break
        data.unpersist()
        context = dataset.sparkSession.sparkContext
        made = context._jvm.org.apache.spark.ml.regression.LinearRegressionModel(self.uid, _py2java(context, Vectors.dense(solution[:-1])), float(solution[-1]))
        made.set("featuresCol", self.getFeaturesCol()).set("labelCol", self.getLabelCol()).set("predictionCol", self.getPredictionCol())
        return LinearRegressionModel(made)


class HingeMachine(
    Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasRegParam, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Linear support vector machine of two classes; minimises what Spark's LinearSVC does.

    That is the mean weighted hinge loss and half of `regParam` times the squared coefficients.  The loss is rounded off
    around its edge, over narrower and narrower widths, and each round takes the best of some steps on Newton's way.  A
    round is two passes in which tasks add up small sums; random Fourier features are made from their inputs in them.
    """

    tolerance = Param(Params._dummy(), "tolerance", "relative gain of a round that ends the rounds of a width", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None, regParam=0.0, maxIter=100, tolerance=1e-4,
    ):
        super().__init__()
        self._setDefault(regParam=0.0, maxIter=100, tolerance=1e-4)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LinearSVCModel:
        weight = F.col(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        label = F.when(F.col(self.getLabelCol()) > 0, 1.0).otherwise(-1.0)
        data, expand = _inputs(dataset, self.getFeaturesCol(), label.alias("y"), weight.alias("w"))
        many = data.rdd.getNumPartitions() > PARTS
        penalty = self.getOrDefault(self.regParam) * (data.agg(F.sum("w")).first()[0] or 0.0)
        solution, rounds, tolerance = _least_squares(data, many, expand, penalty), self.getOrDefault(self.maxIter), self.getOrDefault(self.tolerance)
        for width in WIDTHS:
            gain = 1.0
            while rounds and gain > tolerance:
                way = _newton_way(data, many, expand, solution, width, penalty)
                losses = _losses(data, many, expand, solution, way, width, penalty)
                best = int(np.argmin(losses))
                gain, rounds = 1 - losses[best] / max(losses[0], 1e-300), rounds - 1
                solution = solution + (0.0, *STEPS)[best] * way
        data.unpersist()
        context = dataset.sparkSession.sparkContext
        made = context._jvm.org.apache.spark.ml.classification.LinearSVCModel(self.uid, _py2java(context, Vectors.dense(solution[:-1])), float(solution[-1]))
        made.set("featuresCol", self.getFeaturesCol()).set("labelCol", self.getLabelCol()).set("predictionCol", self.getPredictionCol())
        return LinearSVCModel(made)


def _inputs(dataset: DataFrame, features: str, *columns: Column) -> tuple[DataFrame, Callable | None]:
    """The persisted rows of a fit: `x`, for random features what they are made from, and `columns`; and what makes them."""
    made = dataset.schema[features].metadata.get("fourier")
    inputs, expand = features, None
    if made is not None and made["source"] in dataset.columns:
        inputs, expand = made["source"], _expansion(made["gamma"], made["size"], made["seed"])
    return dataset.select(vector_to_array(F.col(inputs)).alias("x"), *columns).persist(StorageLevel.MEMORY_AND_DISK), expand


def _least_squares(data: DataFrame, many: bool, expand: Callable | None, penalty: float) -> np.ndarray:
    """Coefficients and, last, the intercept that fit (x, y, weight); the intercept is not penalised."""
    def part(x, y, w):
        both = np.column_stack([x, np.ones(len(y)), y])
        return (both * w[:, None]).T @ both

    total = _total(data, many, expand, part)
    return np.linalg.lstsq(total[:-1, :-1] + _penalties(len(total) - 1, penalty), total[:-1, -1], rcond=None)[0]


def _penalties(size: int, penalty: float) -> np.ndarray:
    return np.diag([*[penalty] * (size - 1), 0.0])


def _newton_way(data: DataFrame, many: bool, expand: Callable | None, solution: np.ndarray, width: float, penalty: float) -> np.ndarray:
    """Newton's step from the solution for the loss that is rounded off over the width."""
    def part(x, y, w):
        x = np.column_stack([x, np.ones(len(y))])
        slope = np.clip((1 - y * (x @ solution)) / width + 0.5, 0.0, 1.0)
        curve = w * ((slope > 0) & (slope < 1)) / width
        return np.vstack([(x * curve[:, None]).T @ x, -(w * slope * y) @ x])

    total, held = _total(data, many, expand, part), _penalties(len(solution), penalty)
    curves, slopes = total[:-1] + held, total[-1] + held @ solution
    return -np.linalg.solve(curves + 1e-9 * max(np.trace(curves), 1e-300) / len(slopes) * np.eye(len(slopes)), slopes)


def _losses(data: DataFrame, many: bool, expand: Callable | None, solution: np.ndarray, way: np.ndarray, width: float, penalty: float) -> np.ndarray:
    """The whole loss at the solution and after each of the steps along the way."""
    steps = (0.0, *STEPS)

    def part(x, y, w):
        x = np.column_stack([x, np.ones(len(y))])
        gap, moved = 1 - y * (x @ solution), y * (x @ way)
        found = []
        for step in steps:
            over = np.maximum(gap - step * moved + width / 2, 0.0)
            found.append(w @ np.where(over < width, over * over / (2 * width), over - width / 2))
        return np.array([found])

    penalties = [penalty / 2 * np.sum((solution + step * way)[:-1] ** 2) for step in steps]
    return _total(data, many, expand, part)[0] + penalties


def _total(data: DataFrame, many: bool, expand: Callable | None, part: Callable) -> np.ndarray:
    """The sum of the matrices that `part` gives for pieces of (x, y, ...); those of `many` tasks are added by PARTS tasks first."""
    # Nested, so that workers need no copy of this package.
    def sums(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            inputs = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            others = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            for i in range(0, batch.num_rows, 1024):
                x = inputs[i:i + 1024]
                found = part(expand(x) if expand else x, *[c[i:i + 1024] for c in others])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([len(total)]), pa.array([total.ravel()], pa.list_(pa.float64()))], ["height", "sums"])

    def added(batches):
        height, total = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                height = batch.column(0)[0].as_py()
                total = total + batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=0)
        if height:
            yield pa.RecordBatch.from_arrays([pa.array([height]), pa.array([total], pa.list_(pa.float64()))], ["height", "sums"])

    schema = "height bigint, sums array<double>"
    parts = data.mapInArrow(sums, schema)
    if many:
        parts = parts.repartition(PARTS).mapInArrow(added, schema)
    found = parts.collect()
    if not found:
        raise ValueError("no rows to fit")
    return np.sum([np.array(r["sums"]) for r in found], axis=0).reshape(found[0]["height"], -1)


def _solved(data: DataFrame, many: bool, expand: Callable | None, solution: np.ndarray | None, epsilon: float, c: float) -> np.ndarray:
    """Coefficients and, last, the intercept of one round over (x, y); without a `solution` all rows weigh 1."""
    def part(x, y):
        weight, goal = np.ones(len(y)), y
        if solution is not None:
            now = x @ solution[:-1] + solution[-1]
            gap = y - now
            outside = np.abs(gap) - epsilon
            weight = np.where(outside > 0, 1.0 / np.maximum(outside, 1e-3), 1e-6)
            goal = np.where(outside > 0, y - epsilon * np.sign(gap), now)
        both = np.column_stack([x, np.ones(len(y)), goal])
        return (both * weight[:, None]).T @ both

    total = _total(data, many, expand, part)
    n = len(total)
    inner, first, weight = total[:-2, :-2], total[:-2, -2], total[-2, -2]
    means, goal = first / weight, total[-2, -1] / weight
    coefficients = np.linalg.solve(inner - np.outer(first, means) + np.eye(n - 2) / c, total[:-2, -1] - first * goal)
    return np.append(coefficients, goal - coefficients @ means)
