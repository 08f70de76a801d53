"""The bound on fitted rows: which rows it takes, and what it leaves whole."""

from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from caseloom.operators.splits import assign_folds
from caseloom.plans import training as runs
from caseloom.plans.models import FIT, RAW, default_models, fit_pipeline
from caseloom.plans.training import mark_fit_rows, train
from registry.learning import FIT_ROWS, _value_sides


def test_copies_and_rare_classes_are_taken_in_their_share(spark):
    """A third of all rows has equal features, and a class has 15 rows."""
    rows = spark.range(6000).select(
        F.col("id").alias("key"), (F.col("id") % 5).alias("fold"), (F.col("id") < 15).cast("double").alias("label"),
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"))
    taken = mark_fit_rows(rows, 600, "key", ["fold", "label"]).where(FIT)
    copies, rare, all_taken = taken.agg(F.count_if(F.expr("x = -1")), F.count_if(F.expr("label = 1")), F.count("*")).first()
    assert all_taken == 600 and 150 <= copies <= 250 and rare == 15
    assert taken.select("fold").distinct().count() == 5


def test_the_scaler_sees_all_rows(spark):
    rows = spark.createDataFrame([(float(i % 2), Vectors.dense(float(i)), 1.0, i < 20) for i in range(100)], ["label", RAW, "weight", FIT])
    model = fit_pipeline(rows, default_models("classification", 20, 2)["Logistic Regression"], "standard")
    assert model.stages[0].mean[0] == 49.5 and len(model.stages) == 2


def test_regressors_see_all_training_rows(spark):
    sf = "/root/testdata/sf0.001"
    training, test = _value_sides(spark, sf)
    whole = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert training.count() == whole - test.count() > FIT_ROWS


def seen_rows(monkeypatch):
    """The table that the models of a run are fitted on, as fit_models gets it."""
    seen, fit = {}, runs.fit_models

    def watched(table, models, scaler, problem, folds):
        seen.update(rows=table.count(), marked=table.where(FIT).count() if FIT in table.columns else None, copies=table.where(F.col("label") >= 0).groupBy(RAW).count().agg(F.max("count")).first()[0])
        if FIT in table.columns:
            seen["marked_copies"] = table.where(FIT).groupBy(RAW).count().agg(F.max("count")).first()[0]
        return fit(table, models, scaler, problem, folds)

    monkeypatch.setattr(runs, "fit_models", watched)
    return seen


def test_a_regression_run_is_fitted_on_all_rows(spark, monkeypatch):
    seen = seen_rows(monkeypatch)
    table = spark.range(600).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 7 * 1.0).alias("b"), (F.col("id") * 3 + F.col("id") % 7).cast("double").alias("goal"))
    run = train(table, "goal", folds=0, only=["Ridge Regression"], fit_rows=50)
    assert seen["rows"] == 480 and seen["marked"] is None
    assert run.results.first()["r2"] > 0.99


def test_a_class_run_marks_rows_by_their_key(spark, monkeypatch):
    """A third of all rows have equal features: they are fitted on in their share, not as one block."""
    seen = seen_rows(monkeypatch)
    copy = F.col("id") % 3 == 0
    a, b = F.when(copy, 0.5).otherwise(F.rand(3)).alias("a"), F.when(copy, 0.25).otherwise(F.rand(9)).alias("b")
    table = spark.range(1500).select(F.col("id").alias("row_id"), a, b).withColumn("kind", F.when(F.col("a") > 0.5, "hi").otherwise("lo"))
    run = train(table, "kind", folds=2, only=["Logistic Regression"], fit_rows=300)
    assert seen["rows"] == 1200 and seen["marked"] == 300
    assert 0.5 < (seen["marked_copies"] / seen["marked"]) / (seen["copies"] / seen["rows"]) < 1.6
    assert run.results.first()["accuracy"] > 0.8


def test_rows_to_fit_lie_in_all_folds_drawn_by_the_same_key(spark):
    rows = spark.range(6000).select(F.xxhash64("id").alias(runs.ROW), (F.col("id") % 3 == 0).cast("double").alias("label"))
    folded = assign_folds(rows, 5, stratify="label", seed=runs.FOLD_SEED, key=runs.ROW, out=runs.FOLD)
    taken = mark_fit_rows(folded, 600, runs.ROW, ["label", runs.FOLD]).where(FIT).groupBy(runs.FOLD, "label").count().collect()
    assert len(taken) == 10 and all(20 <= r["count"] <= 120 for r in taken)


def test_rows_to_fit_are_found_by_all_tasks(spark):
    """The mark tells the task that made it: one task for the whole table would mark nothing."""
    later = F.udf(lambda: TaskContext.get().partitionId() > 0, "boolean").asNondeterministic()
    rows = spark.range(200, numPartitions=4).select(
        (F.col("id") % 2).cast("double").alias("label"), array_to_vector(F.array(F.col("id").cast("double"))).alias(RAW), F.lit(1.0).alias("weight"), later().alias(FIT))
    model = fit_pipeline(rows, default_models("classification", 150, 2)["Logistic Regression"], "standard")
    assert model.stages[0].mean[0] == 99.5 and len(model.stages) == 2


def test_marking_leaves_the_rows_of_a_class_in_their_tasks(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 8000, 1, 8).select(F.col("id").alias("key"), (F.col("id") % 2).alias("label"))
        largest = mark_fit_rows(rows, 600, "key", ["label"]).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert largest == 1000
