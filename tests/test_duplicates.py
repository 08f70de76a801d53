"""Duplicates by hashes first, alerts and reports by sketches, against exact figures."""

import pytest

from caseloom.operators.cleaning import drop_duplicates
from caseloom.operators.profile import alerts, duplicate_count, health_report

ROWS = [
    (1, "a", 0.0, [1]), (1, "a", -0.0, [1]), (1, None, 1.0, None), (None, "1", 1.0, None), (None, None, None, None), (None, None, None, None),
    (2, "b", float("nan"), []), (2, "b", float("nan"), []), (3, "", 2.0, [1, 2]), (3, None, 2.0, [1, 2]),
] + [(9, "hot", 1.0, [5])] * 40


@pytest.mark.parametrize("known", [100_000, 1])
def test_one_row_of_each_set_stays(spark, known):
    df = spark.createDataFrame(ROWS, "n int, t string, x double, a array<int>")
    found = drop_duplicates(df, known)
    assert found.columns == df.columns
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, (tuple(r) for r in df.dropDuplicates().collect())))
    groups = df.groupBy(*df.columns).count().count()
    assert duplicate_count(df).first()[0] == len(ROWS) - groups == 42


def test_rows_that_do_not_repeat_are_not_moved(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as string) AS t")
    assert drop_duplicates(df) is df
    few = df.union(df.where("id < 5"))
    plan = drop_duplicates(few)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and drop_duplicates(few).count() == 1000
    assert drop_duplicates(df.limit(0)).count() == 0


def test_alerts_need_exact_distinct_texts(spark):
    """Sketches alone would take a column with one repeated text for unique."""
    df = spark.range(3000).selectExpr(
        "concat('t', id) AS unique_text", "concat('t', greatest(id, 1)) AS repeated", "if(id = 5, null, concat('t', id)) AS gap", "'x' AS same",
        "double('nan') AS nan", "if(id % 2 = 0, 1.0d, null) AS half", "array(id) AS lists", "id")
    found = {(r.code, r.column, r.detail) for r in alerts(df).collect()}
    assert found == {
        ("unique_text_id", "unique_text", "3000"), ("unique_text_id", "lists", "3000"), ("zero_variance", "same", "x"), ("zero_variance", "half", "1.0"),
        ("high_missing", "nan", "100.0"), ("high_missing", "half", "50.0")}
    assert alerts(df.limit(0)).count() == 0
    assert {(r.code, r.column) for r in alerts(spark.range(4).selectExpr("id % 2 AS a")).collect()} == {("duplicate_rows", None)}


def test_report_by_sketches(spark):
    df = spark.range(5000).selectExpr("id", "concat('t', id % 1000) AS t", "id % 7 / 2 AS x")
    exact, rough = (health_report(df, e)["columns"].drop("unique_count") for e in (True, False))
    assert exact.collect() == rough.collect()
    counts = {r["name"]: r["unique_count"] for r in health_report(df, False)["columns"].collect()}
    assert abs(counts["id"] - 5000) < 500 and abs(counts["t"] - 1000) < 100 and counts["x"] == 7
    assert "Generate" not in health_report(df.select("id"), False)["columns"]._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
