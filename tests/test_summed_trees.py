"""Trees over sums per cell: against Spark's trees on rows, how often rows are read, saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from caseloom.plans.models import regressors
from caseloom.plans.summed_trees import SummedTrees, drawn_sums, split_points
from caseloom.plans.training import feature_importance


def few_cells(spark, n=4000, parts=1, seed=3):
    """Two features of 12 and 6 values and a flag, and a noisy target."""
    made = np.random.default_rng(seed)
    x = np.column_stack([made.integers(0, 12, n), made.integers(0, 6, n) / 7, made.integers(0, 2, n)]).astype(float)
    y = 3 * x[:, 0] + 10 * x[:, 1] * x[:, 2] + made.normal(size=n)
    rows = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    return rows.repartition(parts).persist()


def predictions(model, rows):
    return np.array([r.prediction for r in model.transform(rows).select("prediction").collect()])


def tasks_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    result, tracker = run(), spark.sparkContext.statusTracker()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return result, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i is not None)


def test_boosting_on_cells_equals_boosting_on_rows(spark):
    """Without left out rows both are the same trees."""
    rows = few_cells(spark)
    boosting = GBTRegressor(maxIter=6, stepSize=0.3, maxDepth=3, seed=1)
    model, plain = SummedTrees(boosting).fit(rows), boosting.fit(rows)
    assert isinstance(model, PipelineModel) and isinstance(model.stages[-1], GBTRegressionModel)
    assert predictions(model, rows) == pytest.approx(predictions(plain, rows), rel=1e-9)
    assert model.stages[-1].featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), rel=1e-6)
    assert model.stages[-1].treeWeights == plain.treeWeights == [1.0, *[0.3] * 5]


def test_rounds_of_boosting_do_not_read_the_rows(spark):
    """The tasks of a fit do not grow by rounds times partitions of the rows: of 40 partitions and 8 rounds here."""
    rows = few_cells(spark, parts=40)
    rows.count()
    model, tasks = tasks_of(spark, "boosting", lambda: regressors(effort=0.08)["Gradient Boosting (Tuned)"][0].fit(rows))
    assert model.transform(rows).count() == 4000 and tasks < 600


def test_rows_are_drawn_for_themselves(spark):
    """A cell with most of the rows is drawn by its rows, not as a whole; labels' sums are those of the drawn rows."""
    rows = spark.range(40_000, numPartitions=3).select(F.when(F.col("id") % 4 == 0, 1).otherwise(0).cast("bigint").alias("cell"), (F.col("id") % 2).cast("double").alias("label"))
    for again, spread in ((False, 0.8 * 0.2), (True, 1.0)):
        rate = 1.0 if again else 0.8
        found = {r["cell"]: np.array(r["sums"]).reshape(2, 50) for r in drawn_sums(rows, 50, rate, again, 7, 2).collect()}
        assert sorted(found) == [0, 1]
        for cell, n in ((0, 30_000), (1, 10_000)):
            taken, total = found[cell]
            assert abs(taken.mean() / n - rate) < 0.01 and 0.5 < taken.var() / (n * spread) < 2
            assert (abs(total - taken * (2 / 3 if cell == 0 else 0.0)) < 600).all()


def test_times_that_a_row_is_drawn_follow_the_law(spark):
    """Each row is a cell: its counts are those of Poisson's law."""
    rows = spark.range(4000, numPartitions=2).select(F.col("id").alias("cell"), F.lit(1.0).alias("label"))
    times = np.array([r["sums"][:50] for r in drawn_sums(rows, 50, 1.0, True, 3, 2).collect()])
    shares = [(times == k).mean() for k in range(5)]
    assert shares == pytest.approx([np.exp(-1) / f for f in (1, 1, 2, 6, 24)], abs=0.004) and times.max() >= 6


def test_a_forest_on_cells_is_as_good_as_on_rows(spark):
    rows, test = few_cells(spark), few_cells(spark, 2000, seed=4)
    forest = RandomForestRegressor(numTrees=30, maxDepth=5, featureSubsetStrategy="all", seed=1)
    model, plain = SummedTrees(forest).fit(rows), forest.fit(rows)
    assert isinstance(model.stages[-1], RandomForestRegressionModel) and model.stages[-1].getNumTrees == 30
    errors = [np.mean((predictions(m, test) - [r.label for r in test.select("label").collect()]) ** 2) for m in (model, plain)]
    assert errors[0] < errors[1] * 1.05
    assert model.stages[-1].featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=0.01)


def test_trees_of_a_forest_do_not_read_the_rows(spark):
    """The rows, in 40 partitions here, are read for the split points, the number of cells and their sums."""
    rows = few_cells(spark, parts=40)
    rows.count()
    _, tasks = tasks_of(spark, "forest", lambda: regressors(effort=0.08)["Random Forest (Tuned)"][0].fit(rows))
    assert tasks < 400


def test_boosting_is_saved_and_loaded(spark, tmp_path):
    rows = few_cells(spark)
    model = PipelineModel(stages=[SummedTrees(GBTRegressor(maxIter=3, subsamplingRate=0.8, seed=2)).fit(rows)])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert predictions(again, rows).tolist() == predictions(model, rows).tolist()
    named = {r.feature: r.importance for r in feature_importance(spark, PipelineModel(stages=[again.stages[0], again.stages[0]]), ["a", "b", "flag"]).collect()}
    assert sum(named.values()) == pytest.approx(1) and max(named, key=named.get) == "a"


def test_many_cells_are_fitted_by_rows(spark):
    made = np.random.default_rng(5)
    x = made.uniform(size=(500, 3))
    rows = spark.createDataFrame([(float(a.sum()), Vectors.dense(a)) for a in x], ["label", "features"])
    assert isinstance(SummedTrees(GBTRegressor(maxIter=2, seed=1)).fit(rows), GBTRegressionModel)


def test_split_points():
    assert split_points(np.array([3.0, 1.0, 1.0, 2.0]), 32) == [1.5, 2.5]
    assert split_points(np.ones(4), 32) == []
    many = split_points(np.arange(1000.0), 32)
    assert len(many) == 31 and max(np.diff(many)) <= 33
