"""Classifiers are fitted on all rows: what queries give to the models, and fits on groups and by passes against Spark's on rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from caseloom.plans import boosting, summed_classes
from caseloom.plans import training as runs
from caseloom.plans.boosting import SoftmaxBoosting
from caseloom.plans.kernels import FourierFeatures, HingeMachine
from caseloom.plans.models import FIT
from caseloom.plans.summed_classes import SummedClasses, drawn_groups, points_of_all
from caseloom.plans.summed_trees import BINNED
from registry import learning

SF = "/root/testdata/sf0.001"


def few_cells(spark, n=4000, classes=2, parts=1, seed=3):
    """Two features of 12 and 6 values and a flag, and a noisy class with weights."""
    made = np.random.default_rng(seed)
    x = np.column_stack([made.integers(0, 12, n), made.integers(0, 6, n) / 7, made.integers(0, 2, n)]).astype(float)
    y = np.digitize(x[:, 0] + 6 * x[:, 1] * x[:, 2] + made.normal(size=n), np.linspace(0, 14, classes + 1)[1:-1])
    rows = spark.createDataFrame([(float(b), float(1 + b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "weight", "features"])
    return rows.repartition(parts).persist()


def chances(model, rows):
    return np.array([r.p for r in model.transform(rows).select(vector_to_array("probability").alias("p")).collect()])


class Seen(Exception):
    pass


@pytest.mark.parametrize("place, query", [(learning, "one_model"), (learning, "three_classes"), (runs, "training_run")])
def test_queries_fit_classifiers_on_all_training_rows(spark, monkeypatch, place, query):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()

    def watched(rows, *_, **__):
        assert FIT not in rows.columns and abs(rows.count() - 0.8 * lines) <= 2
        raise Seen

    monkeypatch.setattr(place, "fit_models", watched)
    learning._class_run.cache_clear()
    named = {"problem": "classification", "name": "Random Forest"} if query == "one_model" else {}
    with pytest.raises(Seen):
        getattr(learning, query)(spark, SF, **named)


def test_folds_are_fitted_on_all_their_rows(spark, monkeypatch):
    def watched(rows, *_, **__):
        assert FIT not in rows.columns and rows.count() > learning.FIT_ROWS
        raise Seen

    monkeypatch.setattr(learning, "cross_validate", watched)
    with pytest.raises(Seen):
        learning.folds_scored(spark, SF)


def test_boosting_on_groups_equals_boosting_on_rows(spark):
    rows = few_cells(spark)
    made = GBTClassifier(maxIter=6, stepSize=0.3, maxDepth=3, seed=1)
    model, plain = SummedClasses(made).fit(rows), made.fit(rows)
    assert isinstance(model, PipelineModel)
    assert chances(model, rows) == pytest.approx(chances(plain, rows), abs=1e-9)
    assert model.stages[-1].featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-6)


def test_softmax_boosting_on_groups_equals_boosting_on_rows(spark, monkeypatch):
    rows, test = few_cells(spark, classes=3), few_cells(spark, 500, classes=3, seed=5)
    made = SoftmaxBoosting(classes=3, maxIter=4, stepSize=0.5)
    called = []
    monkeypatch.setattr(boosting, "grouped_rows", lambda *a: called.append(summed_classes.grouped_rows(*a)) or called[-1])
    model = made.fit(rows)
    assert called[0].size < 450 and called[0].table.agg(F.sum("n")).first()[0] == 4000
    monkeypatch.setattr(boosting, "grouped_rows", lambda *a: None)
    assert chances(model, test) == pytest.approx(chances(made.fit(rows), test), abs=1e-9)


def test_a_forest_on_groups_is_as_good_as_on_rows(spark, tmp_path):
    rows, test = few_cells(spark), few_cells(spark, 2000, seed=4)
    made = RandomForestClassifier(weightCol="weight", numTrees=30, maxDepth=8, featureSubsetStrategy="sqrt", seed=1)
    model, plain = SummedClasses(made).fit(rows), made.fit(rows)
    assert isinstance(model.stages[-1], RandomForestClassificationModel) and model.stages[-1].getNumTrees == 30
    assert np.abs(chances(model, test) - chances(plain, test)).mean() < 0.03
    assert model.stages[-1].featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=0.08)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert chances(PipelineModel.load(str(tmp_path / "m")), test).tolist() == chances(model, test).tolist()


def test_a_rare_class_that_a_tree_does_not_draw_is_kept(spark):
    rows = spark.createDataFrame([(2.0 if i == 0 else float(i % 2), Vectors.dense(float(i % 5), float(i % 2))) for i in range(400)], ["label", "features"])
    model = SummedClasses(RandomForestClassifier(numTrees=12, maxDepth=4, seed=1)).fit(rows)
    assert isinstance(model, PipelineModel) and chances(model, rows).shape == (400, 3)


def test_rows_of_a_group_are_drawn_by_the_law_of_single_rows(spark):
    table = spark.createDataFrame([(Vectors.dense(0.0), 0.0, 1.0, 30_000), (Vectors.dense(1.0), 1.0, 1.0, 1)], [BINNED, "label", "weight", "n"])
    found = {r["label"]: np.array(r["drawn"]) for r in drawn_groups(table, 400, 1.0, 7).collect()}
    assert abs(found[0.0].mean() / 30_000 - 1) < 0.002 and 0.75 < found[0.0].var() / 30_000 < 1.3
    assert [(found[1.0] == k).mean() for k in range(3)] == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2], abs=0.08)


def test_split_points_come_from_all_rows(spark):
    """A value of one row in 60,000, which a sample of 10,000 would most likely miss, and exact shares of many values."""
    rows = spark.range(0, 60_000, 1, 6).select(F.when(F.col("id") == 7, 1.0).otherwise(0.0).alias("a"), F.col("id").cast("double").alias("b"))
    rare, many = points_of_all(rows.select(array_to_vector(F.array("a", "b")).alias("x")), "x", 32)
    assert rare == [0.0] and many == [60_000 / 32 * i - 1 for i in range(1, 32)]


def test_many_groups_are_fitted_by_rows(spark):
    made = np.random.default_rng(5)
    rows = spark.createDataFrame([(float(a.sum() > 1.5), Vectors.dense(a)) for a in made.uniform(size=(300, 3))], ["label", "features"])
    assert not isinstance(SummedClasses(GBTClassifier(maxIter=2, seed=1)).fit(rows), PipelineModel)


def test_the_hinge_machine_is_no_worse_than_a_linear_machine_on_stored_features(spark):
    made = np.random.default_rng(2)
    x = made.uniform(-1, 1, (3000, 2))
    y = (np.hypot(x[:, 0], x[:, 1]) + made.normal(size=3000) * 0.1 > 0.7).astype(float)
    df = spark.createDataFrame([(float(b), float(1 + b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "weight", "inputs"]).repartition(3)
    mapped = FourierFeatures(inputCol="inputs", outputCol="features", size=16, gamma=1.0).transform(df)
    held = dict(weightCol="weight", regParam=1 / 3000, maxIter=100)

    def objective(model):
        rows = model.transform(mapped).select(vector_to_array("rawPrediction")[1].alias("f"), "label", "weight").collect()
        f, label, w = (np.array([r[k] for r in rows]) for k in range(3))
        return np.average(np.maximum(0, 1 - (2 * label - 1) * f), weights=w) + np.sum(model.coefficients.toArray() ** 2) / 6000

    assert objective(HingeMachine(**held).fit(mapped)) <= 1.002 * objective(LinearSVC(standardization=False, **held).fit(mapped))


def test_fits_of_a_run_are_spread_over_tasks(spark, monkeypatch):
    """The prepared rows lie in one partition, as joins of a small table leave them; fits read them by more than one task."""
    def watched(rows, *_, **__):
        held = rows.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in held) == 480 and len(held) == 5 and max(r["count"] for r in held) <= 110
        raise Seen

    monkeypatch.setattr(runs, "TASK_ROWS", 100)
    monkeypatch.setattr(runs, "fit_models", watched)
    rows = spark.range(0, 600, 1, 1).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 7 * 1.0).alias("b"), (F.col("id") * 3 + F.col("id") % 7).cast("double").alias("goal"))
    with pytest.raises(Seen):
        runs.train(rows, "goal", folds=0, only=["Ridge Regression"])
