"""Multiclass boosting: against one-vs-rest and a plain round, and saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from caseloom.plans.boosting import SoftmaxBoosting, leaf_numbers
from caseloom.plans.models import default_models
from caseloom.plans.training import feature_importance


def ring_rows(spark, n=600, seed=4):
    """Three classes in two features that no single line parts; a third feature says nothing."""
    made = np.random.default_rng(seed)
    x = made.uniform(-1, 1, (n, 3))
    y = np.digitize(np.hypot(x[:, 0], x[:, 1]) + made.normal(size=n) * 0.05, [0.5, 0.85])
    return spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"]).coalesce(1).persist()


def log_loss(scored):
    p = vector_to_array("probability")[F.col("label").cast("int")]
    return scored.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15))))).first()[0]


def test_below_one_vs_rest_saved_and_loaded(spark, tmp_path):
    rows, test = ring_rows(spark), ring_rows(spark, 400, 5)
    model = SoftmaxBoosting(classes=3, maxIter=20, stepSize=0.4, seed=1).fit(rows)
    scored = model.transform(test)
    assert scored.where("prediction = label").count() > 330
    chances = scored.select(vector_to_array("probability").alias("p")).collect()
    assert all(sum(r.p) == pytest.approx(1) and min(r.p) > 0 for r in chances)
    other = OneVsRest(classifier=GBTClassifier(maxIter=20, stepSize=0.4, maxDepth=3, seed=1)).fit(rows).transform(test)
    squashed = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate("s", F.lit(0.0), lambda a, b: a + b)
    other = other.withColumn("s", squashed).withColumn("probability", F.transform("s", lambda v: v / total))
    rest = other.agg(F.avg(-F.log(F.greatest(F.col("probability")[F.col("label").cast("int")], F.lit(1e-15))))).first()[0]
    assert log_loss(scored) < rest
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(test).select("prediction", "probability").collect() == scored.select("prediction", "probability").collect()
    named = {r.feature: r.importance for r in feature_importance(spark, PipelineModel(stages=[again.stages[0], again.stages[0]]), ["a", "b", "noise"]).collect()}
    assert sum(named.values()) == pytest.approx(1) and named["noise"] < min(named["a"], named["b"])


def test_one_round_matches_the_plain_step(spark):
    """Leaves hold the Newton step of the gaps between classes and their shares."""
    rows = ring_rows(spark, 300, 7)
    held = SoftmaxBoosting(classes=3, maxIter=1, stepSize=1.0).fit(rows).held
    data = rows.collect()
    x, y = np.array([r.features.toArray() for r in data]), np.array([int(r.label) for r in data])
    share = np.bincount(y, minlength=3) / len(y)
    assert held["start"] == pytest.approx(np.log(share).tolist())
    for k, (nodes, values) in enumerate(held["rounds"][0]):
        gap, leaf = (y == k) - share[k], leaf_numbers(nodes, x)
        for i in np.unique(leaf):
            own = gap[leaf == i]
            assert values[i] == pytest.approx(2 / 3 * own.sum() / (np.abs(own) * (1 - np.abs(own))).sum())


def test_margins_are_written_every_few_rounds(spark, monkeypatch):
    from caseloom.plans import boosting

    rows = ring_rows(spark, 200, 8)
    whole = SoftmaxBoosting(classes=3, maxIter=4).fit(rows).held
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    parts = SoftmaxBoosting(classes=3, maxIter=4).fit(rows).held
    assert [[t[0] for t in r] for r in parts["rounds"]] == [[t[0] for t in r] for r in whole["rounds"]]


def test_default_for_more_than_two_classes():
    stages = default_models("classification", 100, 4)["Gradient Boosting"]
    assert isinstance(stages[0], SoftmaxBoosting) and stages[0].getOrDefault("classes") == 4
