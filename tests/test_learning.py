"""Training runs beat a trivial guess, survive saving, and score new rows."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.plans.scoring import score, split_valid
from caseloom.plans.training import load_run, save_run, train

rng = random.Random(3)


@pytest.fixture(scope="module")
def classes(spark):
    rows = []
    for i in range(300):
        x, noise = rng.uniform(-3, 3), rng.random()
        rows.append((i, x, noise if i % 9 else None, rng.choice(["red", "blue"]), "low" if x < -1 else "mid" if x < 1 else "high"))
    return spark.createDataFrame(rows, "id int, x double, noise double, colour string, y string")


@pytest.fixture(scope="module")
def run(classes):
    return train(classes, "y", effort=0.05, folds=2)


def test_multiclass_run(run, spark):
    assert run.problem_type == "classification" and run.labels == ["high", "low", "mid"]
    found = {r["model"]: r["accuracy"] for r in run.results.collect()}
    assert set(found) == {"Logistic Regression", "Random Forest", "Gradient Boosting", "Support Vector Classifier"}
    assert max(found.values()) > 0.8
    assert run.cv_results.count() == 4 and run.recommended in run.models
    assert "x" in run.recipe.selected and "colour_red" in run.recipe.features
    assert run.importance(spark, "Random Forest").first()["feature"] == "x"
    assert run.top_features(spark, "Logistic Regression").first()["feature"] == "x"
    assert run.importance(spark, "Support Vector Classifier").count() == 0
    assert run.model_list().where("recommended").count() == 1
    assert {r["step"] for r in run.reports["cleaning"].collect()} >= {"initial_rows", "dropped_id_column", "final_rows"}


def test_scoring_and_saving(run, classes, spark, tmp_path):
    save_run(run, str(tmp_path / "run"))
    loaded = load_run(spark, str(tmp_path / "run"))
    assert loaded.recipe == run.recipe or loaded.recipe.features == run.recipe.features
    new = classes.drop("y", "noise", "colour")
    for model in run.models:
        a = score(new, run, model).orderBy("id").collect()
        b = score(new, loaded, model).orderBy("id").collect()
        assert [r["predicted_class"] for r in a] == [r["predicted_class"] for r in b]
        assert all(abs(sum(r["class_probabilities"]) - 1) < 1e-6 and 0 < r["confidence"] <= 1 for r in a)
        assert a[0]["class_labels"] == ["high", "low", "mid"]
    with pytest.raises(ValueError, match="no trained model"):
        score(new, run, "other")


def test_logged_regression(spark):
    rows = [(float(a), rng.choice("uv"), float(2.718281828 ** (a / 10))) for a in (rng.uniform(0, 50) for _ in range(300))]
    df = spark.createDataFrame(rows, "a double, c string, y double")
    run = train(df, "y", effort=0.05, folds=2, priority="r2")
    assert run.was_log_transformed and run.problem_type == "regression"
    found = {r["model"]: r["r2"] for r in run.results.collect()}
    assert len(found) == 5 and found["Ridge Regression"] > 0.95 and found["Support Vector Regressor"] > 0.5
    scored = score(df, run, "Ridge Regression")
    assert scored.agg(F.corr("y", "prediction")).first()[0] > 0.95


def test_ticket_run(spark):
    rows = []
    for i in range(200):
        bad = i % 2 == 0
        rows.append((str(i), f"2024-01-{i % 28 + 1:02d} 08:00", f"2024-03-{(1 if bad else 20) + i % 5:02d}",
                     "router outage error" if bad else "billing question invoice", "high" if bad else "low", f"owner {i % 3}", "Core" if i % 3 else "Edge"))
    df = spark.createDataFrame(rows, ["Case Number", "Date Open", "Solution Target", "Subject", "Priority", "Case Owner", "Product"])
    run = train(df, task="priority", effort=0.05, folds=2, only=["Logistic Regression"])
    assert run.results.first()["accuracy"] > 0.95
    new = spark.createDataFrame([("a", "outage of the router", "core"), ("b", "question about an invoice", None)], "id string, case_description string, product string")
    assert [r["predicted_class"] for r in score(new, run).orderBy("id").collect()] == ["high", "low"]
    dated = df.drop("Priority").withColumn("hours_open", F.lit(-1.0))
    agreed = score(dated, run).join(df.select("Case Number", "Priority"), "Case Number").where("predicted_class = Priority")
    assert agreed.count() > 190
    direct = new.withColumn("target_solution_hours", F.lit(24.0 * 45)).withColumn("hours_open", F.lit(5.0))
    assert score(direct, run).columns[:5] == ["id", "case_description", "product", "target_solution_hours", "hours_open"]
    top = run.top_features(spark).first()["feature"]
    assert top in ("case_description", "target_solution_hours")


def test_refused_runs(classes, spark):
    with pytest.raises(ValueError, match="too_few_rows"):
        train(classes.limit(10), "y")
    with pytest.raises(ValueError, match="target_missing"):
        train(classes, "zz")
    with pytest.raises(ValueError, match="either"):
        train(classes)
    with pytest.raises(ValueError, match="test_size"):
        train(classes, "y", test_size=0.9)


def test_scoring_checks(spark):
    df = spark.createDataFrame([("1", "x"), ("-1", "x"), ("no", "x"), ("2", " ")], "n string, d string")
    good, bad = split_valid(df, ["n"], "d")
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["d is empty", "n is negative", "n is not a number"]


def test_ridge_equals_the_closed_form(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from caseloom.plans.models import regressors

    made = np.random.default_rng(0)
    x = made.normal(size=(40, 3))
    x -= x.mean(axis=0)
    y = x @ [30, -20, 5] + made.normal(size=40) * 40
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    model = regressors()["Ridge Regression"][0].fit(df)
    expected = np.linalg.solve(x.T @ x + np.eye(3), x.T @ (y - y.mean()))
    assert model.coefficients.toArray() == pytest.approx(expected, rel=1e-6)


def test_insensitive_regression_ignores_outliers(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from caseloom.plans.kernels import InsensitiveRegression

    made = np.random.default_rng(1)
    x = made.uniform(-1, 1, 200)
    y = 3 * x + made.normal(size=200) * 0.05
    y[:10] += 50
    df = spark.createDataFrame([(float(b), Vectors.dense([float(a)])) for a, b in zip(x, y)], ["label", "features"])
    model = InsensitiveRegression().fit(df)
    assert model.coefficients[0] == pytest.approx(3, abs=0.15) and model.intercept == pytest.approx(0, abs=0.15)


def test_a_round_of_insensitive_regression_is_one_pass(spark):
    """And equals reweighted least squares on stored Fourier features."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from caseloom.plans.kernels import FourierFeatures, InsensitiveRegression

    made = np.random.default_rng(2)
    x = made.uniform(-1, 1, (3000, 2))
    y = np.sin(3 * x[:, 0]) + x[:, 1] + made.normal(size=3000) * 0.3
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "inputs"]).repartition(3)
    mapped = FourierFeatures(inputCol="inputs", outputCol="features", size=16).transform(df)
    spark.sparkContext.setJobGroup("rounds", "rounds of a fit")
    model = InsensitiveRegression(rounds=6, tolerance=0.0).fit(mapped)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) <= 10
    rows = model.transform(mapped).select("features", "label", "prediction").collect()
    features, label = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])
    weight, goal = np.ones(len(label)), label
    for _ in range(7):
        means, centre = np.average(features, axis=0, weights=weight), np.average(goal, weights=weight)
        centred = features - means
        solution = np.linalg.solve((centred * weight[:, None]).T @ centred + np.eye(16), (centred * weight[:, None]).T @ (goal - centre))
        intercept = centre - means @ solution
        now = features @ solution + intercept
        outside = np.abs(label - now) - 0.1
        weight = np.where(outside > 0, 1 / np.maximum(outside, 1e-3), 1e-6)
        goal = np.where(outside > 0, label - 0.1 * np.sign(label - now), now)
    assert model.coefficients.toArray() == pytest.approx(solution, rel=1e-6) and model.intercept == pytest.approx(intercept, rel=1e-6)
    assert [r.prediction for r in rows] == pytest.approx(now, rel=1e-6)
