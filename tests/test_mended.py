"""Robust scaling keeps flags, large dictionaries, splits of repeats, broken CSV lines, copies released."""

import re

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseloom.functions import values
from caseloom.operators.compare import scatter_sample
from caseloom.operators.encoding import encode_target, one_hot_index
from caseloom.operators.profile import column_detail, column_info
from caseloom.operators.splits import assign_folds, assign_test
from caseloom.plans.features import FeatureRecipe
from caseloom.plans.kernels import FourierKernel
from caseloom.plans.models import RAW, cross_validate, regressors, scaler_stage
from caseloom.session import cut_lineage, release_copies
from caseloom.sources.sinks import write_csv
from caseloom.sources.tables import load_table

rng = np.random.default_rng(4)


@pytest.fixture(scope="module")
def flagged(spark):
    """A target made of three numbers with outliers and of a category."""
    x = rng.normal(size=(500, 3))
    x[:10] *= 40
    kinds = rng.choice(["low", "std", "vip"], size=500, p=[0.2, 0.6, 0.2])
    y = x.sum(axis=1) + np.where(kinds == "vip", 60.0, np.where(kinds == "low", -60.0, 0.0))
    rows = [(float(t), *map(float, v), str(k), i % 5) for i, (t, v, k) in enumerate(zip(y, x, kinds))]
    df = spark.createDataFrame(rows, "label double, a double, b double, c double, kind string, fold int")
    recipe = FeatureRecipe(numeric=("a", "b", "c"), categories={"kind": ["low", "std", "vip"]}, selected=("a", "b", "c"))
    return recipe.apply(df, ["label", "fold"]).cache()


def test_robust_scaling_keeps_categories(flagged, tmp_path):
    model = Pipeline(stages=[scaler_stage("robust"), *regressors()["Ridge Regression"]]).fit(flagged)
    assert RegressionEvaluator(metricName="r2").evaluate(model.transform(flagged)) > 0.95
    assert len(model.stages) == 2 and all(abs(w) > 1 for w in model.stages[-1].coefficients.toArray()[[3, 5]])
    model.write().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert RegressionEvaluator(metricName="r2").evaluate(again.transform(flagged)) > 0.95


def test_each_fold_fits_its_own_scaler(flagged):
    found = cross_validate(flagged, regressors()["Ridge Regression"], "robust", "regression")
    assert found.avgMetrics[0] > 0.9 and found.stdMetrics[0] < 0.1 and len(found.bestModel.stages) == 2


def test_kernel_width_follows_the_variance(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(3, 5, (400, 2))], "a double, b double").select(array_to_vector(F.array("a", "b")).alias("v"))
    fitted = FourierKernel(inputCol="v", outputCol="o").fit(df)
    values = np.array([r.v.toArray() for r in df.collect()])
    assert fitted.getOrDefault(fitted.gamma) == pytest.approx(1 / (2 * values.var()), rel=1e-6)


def test_text_columns_of_many_values(spark):
    df = spark.createDataFrame([(i, f"v{i:05}") for i in range(2500)] + [(9999, None)], "i int, t string")
    recipe = FeatureRecipe(categories={"t": [f"v{i:05}" for i in range(2500)]})
    rows = recipe.apply(df.union(spark.createDataFrame([(8888, "unknown")], df.schema)), ["i"]).collect()
    for r in rows:
        vector = r[RAW]
        assert vector.size == 2500 and (vector.toArray().nonzero()[0].tolist() == ([r.i] if r.i < 2500 else []))
    indexed, table = one_hot_index(df, "t")
    assert {(r.i, r.t_index) for r in indexed.collect()} == {(i, i) for i in range(2500)} | {(9999, None)} and table.count() == 2500
    coded, labels = encode_target(df.withColumn("x", F.col("i")), "t")
    assert len(labels) == 2500 and coded.where("i < 2500 AND t <> i OR i = 9999 AND t IS NOT NULL").count() == 0


def test_shares_are_exact_with_repeats_and_nulls(spark):
    df = spark.createDataFrame([(k,) for k in ["a"] * 700 + ["b"] * 250 + [None] * 50], "k string").repartition(5)
    assert assign_test(df, 0.2).where("is_test").count() == 200
    by_class = assign_test(df, 0.2, stratify="k").where("is_test").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in by_class} == {"a": 140, "b": 50, None: 10}
    assert [r["count"] for r in assign_folds(df, 4).groupBy("fold").count().collect()] == [250] * 4


def test_sample_of_repeated_pairs(spark):
    df = spark.range(4000).selectExpr("id % 7 AS a", "id % 3 AS b", "id % 2 AS c")
    assert scatter_sample(df, "a", "b", 500).distinct().count() == 21


def test_empty_numeric_column_and_decimal_samples(spark):
    df = spark.createDataFrame([(None, "9.00"), (None, "10.00"), (None, "100.00"), (None, "2.00")], "e double, d string").withColumn("d", F.col("d").cast("decimal(9,2)"))
    assert column_detail(df, "e")["summary"].first()["type"] == "Empty"
    assert column_info(df).where("name = 'd'").first()["sample_values"] == ["2.00", "9.00", "10.00"]


def test_csv_with_line_breaks(spark, tmp_path):
    rows = [(1, 'two\nlines, "quoted"'), (2, "plain"), (3, "a\r\nb")]
    path = write_csv(spark.createDataFrame(rows, "id bigint, t string"), str(tmp_path / "x.csv"))
    assert [tuple(r) for r in load_table(spark, path, "csv").orderBy("id").collect()][:2] == rows[:2]
    with pytest.raises(ValueError, match="multiline"):
        load_table(spark, path, "csv", multiline=False)


def test_copies_are_released(spark):
    release_copies(spark)
    copy = cut_lineage(spark.range(3))
    assert copy.count() == 3 and release_copies(spark) == 1 and release_copies(spark) == 0


def test_a_written_date_is_tried_in_few_formats():
    """Of the 45 formats at most two are tried on a text, its own among them."""
    from datetime import datetime

    forms = {"yyyy/M/d": "%Y/%m/%d", "{d}/yyyy": "%m/%d/%Y", "{d}/yy": "%m/%d/%y", "d-MMM-yyyy": "%d-%b-%Y", "d MMM yyyy": "%d %b %Y", "MMM d, yyyy": "%b %d, %Y",
             "MMM d yyyy": "%b %d %Y", "d.M.yyyy": "%d.%m.%Y", "yyyyMMdd": "%Y%m%d"}
    times = {"": "", " H:mm": " %H:%M", " H:mm:ss": " %H:%M:%S", " h:mm a": " %I:%M %p", " h:mm:ss a": " %I:%M:%S %p"}
    for date, d in forms.items():
        for time, t in times.items():
            text = datetime(2021, 3, 4, 17, 8, 9).strftime(d + t)
            tried = [(f, g) for f, p in values.DATE_FORMATS.items() if re.search(p, text) for g, q in values.TIME_FORMATS.items() if re.search(q, text)]
            assert (date, time) in tried and len(tried) <= 2


def test_many_labels_stay_off_the_driver(spark):
    texts = [None, "b", "a", "ü", "b", "Z", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    coded, table = encode_target(df, "t", small=3)
    whole, labels = encode_target(df, "t")
    assert coded.columns == df.columns and sorted(coded.collect()) == sorted(whole.collect())
    assert [r["value"] for r in table.orderBy("index").collect()] == labels and not isinstance(table, list)
