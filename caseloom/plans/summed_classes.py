"""Classifiers of trees over counts per cell and class instead of rows.

As in `summed_trees`, rows whose features lie in the same bins, a cell, take the same way through every tree.  Rows of one
cell, class and weight are then alike for a classifier, so all that its trees need of them is their number.  One grouping
of all rows counts them, and trees are fitted on the groups.

A forest takes each row for each tree as often as Poisson's law tells.  How often the rows of a group are taken together
follows the same law with the mean of them all, so it is drawn for groups.
"""

from __future__ import annotations

import json
import math
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from caseloom.operators.quantiles import order_statistics
from caseloom.plans.summed_trees import BINNED, SIDE_BY_SIDE, Binned, cell_numbers
from caseloom.session import cut_lineage

#: Groups of cell, class and weight that trees are fitted on, and the rows that a group has on average at least.  Beyond
#: these, and with other settings than those below, trees are fitted on rows.
MAX_GROUPS, GROUP_ROWS = 300_000, 2
#: Features whose bins make one number.
MOST_FEATURES = 62
#: Groups of a task.
TASK_GROUPS = 32_768


def points_of_all(rows: DataFrame, features: str, bins: int) -> list[list[float]]:
    """Split points of each feature from all rows: all its values but the largest where these are at most `bins`, else
    those that part the rows in `bins` equal shares.  A value at a point lies below it."""
    count = rows.count()
    found: dict[int, list[float]] = {}
    many = set()
    for r in _few_values(rows.select(vector_to_array(features)), bins).distinct().collect():
        many.add(r["feature"]) if r["value"] is None else found.setdefault(r["feature"], []).append(r["value"])
    many |= {k for k, values in found.items() if len(values) > bins}
    if many:
        ranks = sorted({min(count - 1, max(0, round(count * i / bins) - 1)) for i in range(1, bins)})
        names = {f"x{k}": k for k in sorted(many)}
        wide = rows.select(*[vector_to_array(features)[k].alias(c) for c, k in names.items()])
        values = order_statistics(wide, {c: ranks for c in names}, {c: count for c in names})
        found |= {k: sorted({values[c, r] for r in ranks}) for c, k in names.items()}
    return [sorted(found[k]) if k in many else sorted(found[k])[:-1] for k in sorted(found | dict.fromkeys(many))]


def _few_values(rows: DataFrame, most: int) -> DataFrame:
    """`feature, value` for the values of each feature in each task, or one null where they are more than `most`."""
    def values(batches):
        found: list[np.ndarray | None] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = found or [np.empty(0)] * x.shape[1]
            for k, held in enumerate(found):
                if held is not None:
                    both = np.union1d(held, x[:, k])
                    found[k] = both if len(both) <= most else None
        for k, held in enumerate(found):
            n = 1 if held is None else len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * n, pa.int32()), pa.array([None] if held is None else held, pa.float64())], ["feature", "value"])

    return rows.mapInArrow(values, "feature int, value double")


class Groups:
    """`table` has for each group its bins as a vector, `label`, `weight` of one row and `n`, the number of its rows."""

    def __init__(self, points: list[list[float]], table: DataFrame, size: int):
        self.points, self.table, self.size = points, table, size

    @property
    def bins(self) -> int:
        """With so many bins Spark finds a tree's split points from all groups."""
        return max(32, math.isqrt(self.size) + 1)

    def model(self, features: str, fitted: Model) -> PipelineModel:
        return PipelineModel(stages=[Binned(inputCol=features, outputCol=BINNED, points=json.dumps(self.points)), fitted])


def grouped_rows(rows: DataFrame, features: str, label: Column, weight: Column, bins: int) -> Groups | None:
    """Groups of all rows, or None where these are too many for their rows."""
    first = rows.first()
    if first is None or len(first[features]) > MOST_FEATURES:
        return None
    points = points_of_all(rows, features, bins)
    sizes = [len(p) + 1 for p in points]
    if math.prod(sizes) >= 2**62:
        return None
    keys = ["cell", "label", "weight"]
    coded = rows.select(cell_numbers(features, points).alias("cell"), label.cast("double").alias("label"), weight.cast("double").alias("weight"))
    count, groups = coded.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*keys), 0.02)).first()
    if groups > MAX_GROUPS or groups * GROUP_ROWS > count:
        return None
    strides = np.cumprod([1, *sizes[:-1]]).tolist()
    numbers = F.array(*[(F.expr(f"cell div {stride}") % size).cast("double") for stride, size in zip(strides, sizes)])
    counted = coded.groupBy(*keys).agg(F.count("*").alias("n")).repartition(max(1, -(-groups // TASK_GROUPS)), "cell").sortWithinPartitions(*keys)
    table = cut_lineage(counted.select(array_to_vector(numbers).alias(BINNED), "label", "weight", "n"))
    return Groups(points, table, table.count())


class SummedClasses(Estimator):
    """Fits a Spark forest or boosting `estimator` on groups of equal rows in bins, where these are few, else on rows.

    Both give Spark's model; over groups it stands behind the stage that numbers the bins.
    """

    def __init__(self, estimator: GBTClassifier | RandomForestClassifier):
        super().__init__()
        self.estimator = estimator

    def _fit(self, dataset: DataFrame) -> Model:
        made = self.estimator
        if not self._summable():
            return made.fit(dataset)
        features, label = made.getFeaturesCol(), F.col(made.getLabelCol())
        weight = F.col(made.getWeightCol()) if made.isSet(made.weightCol) else F.lit(1.0)
        groups = grouped_rows(dataset, features, label, weight, made.getMaxBins())
        if groups is None:
            return made.fit(dataset)
        fit = self._forest if isinstance(made, RandomForestClassifier) else self._boosting
        return groups.model(features, fit(groups))

    def _summable(self) -> bool:
        made = self.estimator
        if isinstance(made, RandomForestClassifier):
            own = made.getBootstrap()
        else:
            own = made.getSubsamplingRate() == 1.0 and not made.isSet(made.validationIndicatorCol)
        return own and made.getMinInstancesPerNode() == 1

    def _boosting(self, groups: Groups) -> Model:
        made = self.estimator
        weighted = groups.table.select(BINNED, F.col("label").alias(made.getLabelCol()), (F.col("weight") * F.col("n")).alias("rows"))
        return made.copy({made.featuresCol: BINNED, made.weightCol: "rows", made.maxBins: groups.bins}).fit(weighted)

    def _forest(self, groups: Groups) -> RandomForestClassificationModel:
        """One tree a fit, on what was drawn for it; `sqrt` and the like choose among all features at each node."""
        made, trees = self.estimator, self.estimator.getNumTrees()
        chosen = made.getFeatureSubsetStrategy()
        chosen = ("sqrt" if trees > 1 else "all") if chosen == "auto" else chosen
        classes = int(groups.table.agg(F.max("label")).first()[0]) + 1
        nominal = {"ml_attr": {"type": "nominal", "name": made.getLabelCol(), "vals": [str(k) for k in range(max(2, classes))]}}
        table = drawn_groups(groups.table, trees, made.getSubsamplingRate(), made.getSeed()).persist(StorageLevel.MEMORY_AND_DISK)
        table.count()

        def fit(number: int):
            drawn = table.where(F.col("drawn")[number] > 0).select(
                BINNED, F.col("label").alias(made.getLabelCol(), metadata=nominal), (F.col("weight") * F.col("drawn")[number]).alias("rows"))
            alone = made.copy({
                made.featuresCol: BINNED, made.weightCol: "rows", made.maxBins: groups.bins, made.numTrees: 1, made.bootstrap: False,
                made.subsamplingRate: 1.0, made.featureSubsetStrategy: chosen, made.seed: made.getSeed() + number})
            return alone.fit(drawn).trees[0]

        with ThreadPool(SIDE_BY_SIDE) as pool:
            fitted = pool.map(inheritable_thread_target(table.sparkSession)(fit), range(trees), chunksize=1)
        table.unpersist()
        context = table.sparkSession.sparkContext
        package = context._jvm.org.apache.spark.ml.classification
        found = context._gateway.new_array(package.DecisionTreeClassificationModel, trees)
        for i, tree in enumerate(fitted):
            found[i] = tree._java_obj
        model = RandomForestClassificationModel(package.RandomForestClassificationModel(self.uid, found, len(groups.points), max(2, classes)))
        model = made._copyValues(model).setFeaturesCol(BINNED)
        model._transfer_params_to_java()
        return model


def drawn_groups(table: DataFrame, trees: int, rate: float, seed: int) -> DataFrame:
    """Adds `drawn`: for each tree how many rows of the group are taken, each of them as often as Poisson's law of mean `rate` tells."""
    # Nested, so that workers need no copy of this package.
    def draw(batches):
        made = np.random.default_rng([seed % 2**63, TaskContext.get().partitionId()])
        for batch in batches:
            counts = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for i in range(0, len(counts), 4096):
                part = batch.slice(i, 4096)
                times = made.poisson(rate * counts[i:i + 4096, None], (part.num_rows, trees)).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, times.size + 1, trees, dtype=np.int32), pa.array(times.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], ["numbers", "label", "weight", "drawn"])

    plain = table.select(vector_to_array(BINNED).alias("numbers"), "label", "weight", "n")
    drawn = plain.mapInArrow(draw, "numbers array<double>, label double, weight double, drawn array<int>")
    return drawn.select(array_to_vector("numbers").alias(BINNED), "label", "weight", "drawn")
