"""Forests and boosting of regression trees over sums per cell instead of rows.

Spark's trees see a feature only by the bin that its value lies in, at most `maxBins` of them.  Rows whose features lie in
the same bins, a cell, take the same way through every tree, and the best splits and the leaves follow from the number
and the sum of the labels that each cell holds.  So one pass over all rows adds these up, and trees are fitted on cells.

A forest takes each row several times or not at all for each tree, boosting leaves some rows out in each round.  These draws
are made for every row and tree in that pass, so a cell has a number and a sum for each tree.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.regression import (
    DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from caseloom.session import cut_lineage

BINNED = "binned_features"
#: Rows that split points are taken from, at least; Spark's trees take as many.
SAMPLE_ROWS = 10_000
#: Cells that a task may hold the sums of (1.6 KB each for 100 trees), and the rows that a cell has on average at least.
#: Beyond these, and with other settings than those below, trees are fitted on rows.
MAX_CELLS, CELL_ROWS = 150_000, 16
#: Cells of a task that fits trees.
TASK_CELLS = 4_096
#: Trees of a forest that are fitted side by side.
SIDE_BY_SIDE = 8


def split_points(values: np.ndarray, bins: int) -> list[float]:
    """Middles between neighbouring values: all, or those nearest to equal shares of the values where these are more than bins."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) >= bins:
        goals = len(values) / bins * np.arange(1, bins)
        upto = np.cumsum(counts)[:-1]
        middles = middles[np.unique([np.abs(upto - goal).argmin() for goal in goals])]
    return middles.tolist()


def _numbers_of_bins(points: list[list[float]]) -> Callable[[pa.Array], np.ndarray]:
    # Nested, so that workers need no copy of this package.
    def place(rows: pa.Array) -> np.ndarray:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(points))
        return np.column_stack([np.searchsorted(p, x[:, k]) for k, p in enumerate(points)])

    return place


class Binned(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The number of each feature's bin: how many of its split points lie below the value."""

    points = Param(Params._dummy(), "points", "split points of each feature, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, points="[]"):
        super().__init__()
        self._setDefault(points="[]")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        place = _numbers_of_bins(json.loads(self.getOrDefault(self.points)))

        @F.arrow_udf("array<double>")
        def number(rows: pa.Array) -> pa.Array:
            if not len(rows):
                return pa.array([], pa.list_(pa.float64()))
            values = place(rows).astype(float)
            return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))

        out = self.getOutputCol()
        return dataset.select(*[c for c in dataset.columns if c != out], array_to_vector(number(vector_to_array(F.col(self.getInputCol())))).alias(out))


class SummedTrees(Estimator):
    """Fits a Spark forest or boosting `estimator` of regression trees on sums per cell, where cells are few, else on rows.

    Both give Spark's model; over cells it stands behind the stage that numbers the bins.  Impurities in its nodes are
    those between cells; gains, importances and predictions are those of the rows.
    """

    def __init__(self, estimator: GBTRegressor | RandomForestRegressor):
        super().__init__()
        self.estimator = estimator

    def _fit(self, dataset: DataFrame) -> Model:
        made = self.estimator
        rows = dataset.select(F.col(made.getFeaturesCol()).alias("features"), F.col(made.getLabelCol()).cast("double").alias("label"))
        points = self._points(rows) if self._summable() else []
        sizes = [len(p) + 1 for p in points]
        if not points or math.prod(sizes) >= 2**62:
            return made.fit(dataset)
        coded = rows.select(cell_numbers("features", points).alias("cell"), "label")
        unknown = F.col("label").isNull() | F.isnan("label")
        count, cells, bad = coded.agg(F.count("*"), F.approx_count_distinct("cell", 0.02), F.count_if(unknown)).first()
        if bad or cells > MAX_CELLS or cells * CELL_ROWS > count:
            return made.fit(dataset)
        forest = isinstance(made, RandomForestRegressor)
        trees = made.getNumTrees() if forest else made.getMaxIter()
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        # Each task gives sums of all its cells: there are more tasks only if there are more rows for each.
        tasks = coded.coalesce(max(cores, count // (4 * CELL_ROWS * cells)))
        summed = drawn_sums(tasks, trees, made.getSubsamplingRate(), forest, made.getSeed(), -(-cells // TASK_CELLS))
        strides = np.cumprod([1, *sizes[:-1]]).tolist()
        numbers = F.array(*[(F.expr(f"cell div {stride}") % size).cast("double") for stride, size in zip(strides, sizes)])
        table = cut_lineage(summed.select(array_to_vector(numbers).alias(BINNED), "sums")).persist(StorageLevel.MEMORY_AND_DISK)
        model = (self._forest if forest else self._boosting)(table, trees, len(sizes))
        table.unpersist()
        binned = Binned(inputCol=made.getFeaturesCol(), outputCol=BINNED, points=json.dumps(points))
        model = made._copyValues(model).setFeaturesCol(BINNED)
        model._transfer_params_to_java()
        return PipelineModel(stages=[binned, model])

    def _summable(self) -> bool:
        made = self.estimator
        if isinstance(made, RandomForestRegressor):
            own = made.getBootstrap()
        else:
            own = made.getLossType() == "squared" and not made.isSet(made.validationIndicatorCol)
        plain = made.getMinInstancesPerNode() == 1 and made.getMinWeightFractionPerNode() == 0.0 and not made.isSet(made.weightCol)
        return own and plain and made.getFeatureSubsetStrategy() == "all"

    def _points(self, rows: DataFrame) -> list[list[float]]:
        """Split points of each feature, or none where there are too many features for a cell's number."""
        first = rows.first()
        if first is None or len(first["features"]) > 62:
            return []
        bins = self.estimator.getMaxBins()
        share = min(1.0, max(SAMPLE_ROWS, bins * bins) / rows.count())
        found = rows.select(vector_to_array("features").alias("x")).sample(share, seed=self.estimator.getSeed()).collect()
        return [split_points(v, bins) for v in np.array([r["x"] for r in found]).T]

    def _tree(self, table: DataFrame, trees: int, number: int, label: str) -> DecisionTreeRegressionModel:
        """The tree of these draws; `label` may use `mean`, the mean label of the cell's drawn rows."""
        drawn = table.withColumn("weight", F.col("sums")[number]).where("weight > 0").withColumn("mean", F.col("sums")[trees + number] / F.col("weight"))
        # With so many bins Spark finds a tree's split points from all cells.
        bins = max(32, math.isqrt(MAX_CELLS) + 1)
        return DecisionTreeRegressor(
            featuresCol=BINNED, labelCol="goal", weightCol="weight", maxBins=bins, maxDepth=self.estimator.getMaxDepth(),
            minInfoGain=self.estimator.getMinInfoGain(), seed=self.estimator.getSeed(),
        ).fit(drawn.select(BINNED, "weight", F.expr(label).alias("goal")))

    def _forest(self, table: DataFrame, trees: int, features: int) -> RandomForestRegressionModel:
        fit = inheritable_thread_target(table.sparkSession)(lambda number: self._tree(table, trees, number, "mean"))
        with ThreadPool(SIDE_BY_SIDE) as pool:
            fitted = pool.map(fit, range(trees), chunksize=1)
        jvm, found = _trees(table, fitted)
        return RandomForestRegressionModel(jvm.RandomForestRegressionModel(self.uid, found, features))

    def _boosting(self, table: DataFrame, trees: int, features: int) -> GBTRegressionModel:
        """As in Spark, the first tree counts in full and later ones are fitted on the negative gradient of the squared error."""
        model, fitted, context = None, [], table.sparkSession.sparkContext
        for number in range(trees):
            now, goal = (model.transform(table), "2 * (mean - prediction)") if model else (table, "mean")
            fitted.append(self._tree(now, trees, number, goal))
            jvm, found = _trees(table, fitted)
            weights = context._gateway.new_array(context._jvm.double, len(fitted))
            for i in range(len(fitted)):
                weights[i] = self.estimator.getStepSize() if i else 1.0
            model = GBTRegressionModel(jvm.GBTRegressionModel(self.uid, found, weights, features)).setFeaturesCol(BINNED)
        return model


def _trees(table: DataFrame, fitted: list[DecisionTreeRegressionModel]):
    """Spark's package of regression models, and the trees as its ensembles take them."""
    context = table.sparkSession.sparkContext
    package = context._jvm.org.apache.spark.ml.regression
    found = context._gateway.new_array(package.DecisionTreeRegressionModel, len(fitted))
    for i, tree in enumerate(fitted):
        found[i] = tree._java_obj
    return package, found


def cell_numbers(features: str, points: list[list[float]]):
    """One number for the bins of all features."""
    place = _numbers_of_bins(points)
    strides = np.cumprod([1, *[len(p) + 1 for p in points[:-1]]])

    @F.arrow_udf("bigint")
    def code(rows: pa.Array) -> pa.Array:
        return pa.array(place(rows) @ strides if len(rows) else [], pa.int64())

    return code(vector_to_array(features))


def drawn_sums(coded: DataFrame, trees: int, rate: float, again: bool, seed: int, parts: int) -> DataFrame:
    """`cell, sums` of rows with `cell` and `label`: for each tree how often the cell's rows are drawn, then their labels' sums.

    Each row is drawn for itself: with probability `rate`, or, if it may be drawn `again`, as often as Poisson's law of
    that mean tells.  Tasks add up their rows, and `parts` tasks add up what these give.
    """
    # The shares of rows that are drawn at most 0, 1, 2, ... times, as far as single precision tells them from all.
    law = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(64)])
    upto = law[law < 1 - 2**-24].astype(np.float32) if again else np.array([1 - rate], np.float32)

    # Nested, so that workers need no copy of this package.
    def gathered(chunks):
        """Sums of chunks that are ordered by their cells."""
        place, table = {}, np.zeros((1024, 2 * trees))
        for cells, values in chunks:
            starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            at = [place.setdefault(c, len(place)) for c in cells[starts].tolist()]
            while len(place) > len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            table[at] += np.add.reduceat(values, starts)
        cells = np.fromiter(place, np.int64, len(place))
        for i in range(0, len(cells), 4096):
            n = len(cells[i:i + 4096])
            sums = pa.ListArray.from_arrays(np.arange(0, 2 * trees * n + 1, 2 * trees, dtype=np.int32), pa.array(table[i:i + n].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cells[i:i + n]), sums], ["cell", "sums"])

    def ordered(batch):
        """The batch in pieces, ordered by cells."""
        cells = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(cells, kind="stable")
        for i in range(0, len(order), 2048):
            yield cells[order[i:i + 2048]], order[i:i + 2048]

    def draw(batches):
        drawn = np.random.default_rng([seed % 2**63, TaskContext.get().partitionId()])

        def chunks():
            for batch in batches:
                labels = batch.column(1).to_numpy(zero_copy_only=False)
                for cells, rows in ordered(batch):
                    values, times = np.empty((len(rows), 2 * trees)), np.zeros((len(rows), trees), np.uint8)
                    place = drawn.random(times.shape, np.float32)
                    for share in upto:
                        times += place >= share
                    values[:, :trees] = times
                    np.multiply(values[:, :trees], labels[rows, None], out=values[:, trees:])
                    yield cells, values

        yield from gathered(chunks())

    def add(batches):
        def chunks():
            for batch in batches:
                sums = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for cells, rows in ordered(batch):
                    yield cells, sums[rows]

        yield from gathered(chunks())

    schema = "cell bigint, sums array<double>"
    return coded.mapInArrow(draw, schema).repartition(parts, "cell").mapInArrow(add, schema)
