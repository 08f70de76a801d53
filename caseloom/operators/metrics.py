"""Evaluation of predictions.  Rows are counted once per (label, prediction); all else follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import col, number

# Names of the metrics and the thresholds of the sweep.
CLASSIFICATION_METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "f1_macro")
REGRESSION_METRICS = ("mae", "rmse", "r2")
THRESHOLDS = (0.5, 0.4, 0.3, 0.2, 0.15)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_report_of(counts: DataFrame) -> DataFrame:
    """`label, precision, recall, f1, support, predicted` from confusion counts; 0 for an empty ratio."""
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
    )))
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    return sums.select(
        "label", _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
        "support", "predicted", "hit",
    )


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """`label, precision, recall, f1, support` per class."""
    return class_report_of(confusion(df, label, prediction)).drop("predicted", "hit")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, balanced accuracy, weighted precision/recall/F1, macro F1."""
    report = class_report_of(confusion(df, label, prediction))
    rows, support = F.sum("support"), F.col("support")

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * support), rows).alias(name)

    return report.agg(
        _ratio(F.sum("hit"), rows).alias("accuracy"),
        F.coalesce(F.avg(F.when(support > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        weighted("precision"), weighted("recall"), weighted("f1"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1_macro"),
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mean absolute error, root mean squared error, R2."""
    y, error = number(label), number(label) - number(prediction)
    return df.agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2"),
    )


def threshold_sweep(
    df: DataFrame, label: str = "label", score: str = "score", thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """`threshold, precision, recall, f1` of the positive class; one aggregate for all thresholds."""
    actual = col(label).cast("double") == 1
    flat = df.agg(F.count_if(actual).alias("actual"), *[
        e.alias(f"{k}{i}") for i, t in enumerate(thresholds)
        for k, e in (("hit", F.count_if(actual & (col(score) >= t))), ("said", F.count_if(col(score) >= t)))
    ])
    rows = flat.select(F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"hit{i}").alias("hit"), F.col(f"said{i}").alias("said"),
                 F.col("actual").alias("actual"))
        for i, t in enumerate(thresholds)
    ])))
    return rows.select(
        "threshold", _ratio(F.col("hit"), F.col("said")).alias("precision"),
        _ratio(F.col("hit"), F.col("actual")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("said") + F.col("actual")).alias("f1"),
    )


def recommend(results: DataFrame, problem_type: str, metric: str | None = None) -> DataFrame:
    """The best row of a results table by a metric (errors: lowest), ties by model name."""
    allowed = CLASSIFICATION_METRICS if problem_type == "classification" else REGRESSION_METRICS
    metric = metric or ("f1_macro" if problem_type == "classification" else "r2")
    if metric not in allowed:
        raise ValueError(f"for {problem_type} the metric must be one of {allowed}, not {metric!r}")
    order = F.asc(metric) if metric in ("mae", "rmse") else F.desc_nulls_last(metric)
    return results.orderBy(order, "model").limit(1)


def recommend_by_cv(cv: DataFrame, problem_type: str) -> DataFrame:
    """The model with the best cross-validation mean."""
    metric = "cv_f1_macro_mean" if problem_type == "classification" else "cv_r2_mean"
    return cv.orderBy(F.desc_nulls_last(metric), "model").limit(1)


def compare_with_cv(results: DataFrame, cv: DataFrame, problem_type: str) -> DataFrame:
    """`model, primary, secondary`: test metric beside the cross-validation mean."""
    test, folds = ("f1_macro", "cv_f1_macro_mean") if problem_type == "classification" else ("r2", "cv_r2_mean")
    return results.join(cv, "model", "left").select("model", F.col(test).alias("primary"), F.col(folds).alias("secondary"))


def parent_importance(
    importance: DataFrame, plain: Sequence[str], derived: Sequence[str], parent: str = "case_description"
) -> DataFrame:
    """`feature, importance` summed up to the source column of each encoded feature, highest first."""
    name = F.col("feature")
    source = F.when(name.isin(*derived), parent) if derived else F.when(F.lit(False), parent)
    for c in plain:
        source = source.when((name == c) | name.startswith(f"{c}_"), c)
    return (
        importance.groupBy(source.otherwise(name).alias("feature")).agg(F.sum("importance").alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )
