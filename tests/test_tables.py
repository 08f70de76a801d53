"""Operators on small inline tables with missing values, single classes and odd columns."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caseloom.functions.columns import (
    guess_roles, is_ticket_table, map_roles, missing_roles, normalise_names, resolve_column, split_text_derived,
)
from caseloom.operators import (
    browse, cleaning, combine, compare, dashboard, encoding, metrics, profile, tickets, transforms, validate,
)
from caseloom.sources import sinks, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,price,flag,note,empty\n1,1.5,True,"a, ""b""",\n2,NA,false,n/a,\n3,2,True,x,null\n')
    df = tables.load_table(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "price": "double", "flag": "boolean", "note": "string", "empty": "string"}
    assert rows(df) == [(1, 1.5, True, 'a, "b"', None), (2, None, False, None, None), (3, 2.0, True, "x", None)]
    typed = tables.load_table(spark, str(path), schema="id int, price double, note string")
    assert rows(typed)[1] == (2, None, None)
    with pytest.raises(ValueError, match="format"):
        tables.load_table(spark, "t.xlsx")


def test_sinks_and_run_log(spark, tmp_path):
    assert sinks.combined_name("a.csv", "b.x.csv", "join") == "a_b.x_joined.csv"
    log = str(tmp_path / "runs")
    first = sinks.log_run(spark, log, "d", "y", "Ridge Regression", "r2", 0.5)
    second = sinks.log_run(spark, log, "d", "y", "Ridge Regression")
    assert [r["run_id"] for r in sinks.run_history(spark, log).collect()] == [second, first]
    sinks.clear_history(spark, log)
    assert sinks.run_history(spark, log).count() == 0


def test_stack_aligns_types(spark):
    a = spark.createDataFrame([(1, "x")], "id int, only_a string")
    b = spark.createDataFrame([("7", 2.5)], "id string, only_b double")
    assert rows(combine.stack_tables(a, b)) == [("1", "x", None), ("7", None, 2.5)]
    with pytest.raises(ValueError):
        combine.stack_tables(a.select("only_a"), b.select("only_b"))


def test_join_matches_null_keys(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "key int, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "key long, v string")
    joined = combine.join_tables(a, b)
    assert joined.columns == ["key", "v_a", "v_b"]
    assert sorted(rows(joined), key=str) == [(1, "a", "x"), (None, "b", "y")]
    with pytest.raises(ValueError, match="no row"):
        combine.join_tables(a.where("key = 2"), b, require_match=True)
    assert combine.pick_join_column(a, b) == "key"
    assert combine.pick_join_column(a.select("v"), b.select("v")) == "v"


def test_search_and_preview(spark):
    df = spark.createDataFrame([(1, "Abc", float("inf")), (22, None, float("nan"))], "i int, t string, x double")
    assert [r["i"] for r in browse.search_rows(df, "B").collect()] == [1]
    assert [r["i"] for r in browse.search_rows(df, "2").collect()] == [22]
    assert browse.search_rows(df, " ").count() == 2
    assert [r["x"] for r in browse.preview(df).collect()] == [None, None]
    assert browse.page_count(df, 15) == 1 and browse.page_count(df.limit(0), 15) == 1


def test_names_and_roles(spark):
    df = spark.createDataFrame([(1, 2)], [" Case Number ", "STATUS"])
    assert normalise_names(df).columns == ["case number", "status"]
    with pytest.raises(ValueError, match="collide"):
        normalise_names(spark.createDataFrame([(1, 2)], ["a", " A"]))
    assert resolve_column(df, "Case Number") == " Case Number "
    with pytest.raises(ValueError):
        resolve_column(df, "x")
    mapping = guess_roles(["Case_ID", "Title", "Status", "Opened", "Remedy  Target"])
    assert missing_roles(mapping) == [] and mapping["caseNumber"] == "Case_ID" and mapping["contactName"] is None
    with pytest.raises(ValueError, match="subject"):
        map_roles(df, guess_roles(df.columns))
    assert is_ticket_table(spark.createDataFrame([(1, 2, 3)], ["Priority", "case owner ", "Solution Target"]))
    assert split_text_derived(["a", "tfidf_x", "text_negativity_score"]) == (["a"], ["tfidf_x", "text_negativity_score"])


@pytest.fixture
def small(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a", True, None), (2, float("nan"), "a", False, None), (2, float("nan"), "a", False, None), (3, None, None, None, None)],
        "n int, x double, t string, b boolean, e string",
    )


def test_profile_counts_nan_as_missing(small):
    info = {r["name"]: r for r in profile.column_info(small).collect()}
    assert list(info) == ["n", "x", "t", "b", "e"]
    assert (info["x"]["unique_count"], info["x"]["missing_count"], info["n"]["sample_values"]) == (1, 3, ["1", "2", "3"])
    assert (info["e"]["unique_count"], info["e"]["sample_values"]) == (0, [])
    stats = {r["name"]: r for r in profile.column_stats(small).collect()}
    assert stats["x"]["missing_pct"] == 75.0 and stats["b"]["type"] == "Numeric" and stats["b"]["mean"] == 0.33
    found = {(r["code"], r["column"]) for r in profile.alerts(small).collect()}
    assert found == {
        ("duplicate_rows", None), ("zero_variance", "x"), ("zero_variance", "t"), ("high_missing", "x"), ("high_missing", "e"),
    }


def test_profile_of_an_empty_table(small):
    empty = small.limit(0)
    assert profile.duplicate_count(empty).first()[0] == 0
    assert {r["missing_pct"] for r in profile.column_stats(empty).collect()} == {0.0}
    assert profile.dataset_totals(empty).first()["missing_values"] == 0
    assert profile.health_report(empty)["totals"].first()["missing_pct"] == 0.0


def test_column_detail(spark, small):
    assert profile.column_detail(small, "e")["summary"].first()["type"] == "Empty"
    assert profile.column_detail(small, "b")["summary"].first()["type"] == "Categorical"
    text = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("x",)], "v string")
    detail = profile.column_detail(text, "v")
    assert (detail["summary"].first()["type"], detail["summary"].first()["total_count"]) == ("Numeric", 4)
    flat = profile.column_detail(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v")
    assert [r["count"] for r in flat["distribution"].orderBy("bin_idx").collect()] == [0] * 5 + [2] + [0] * 4
    edges = spark.createDataFrame([(i / 100,) for i in range(11)], "v double")
    assert [r["count"] for r in profile.histograms(edges, ["v"]).orderBy("bin_idx").collect()] == [1] * 9 + [2]


def test_validation(spark, small):
    found = {(r["level"], r["code"], r["detail"]) for r in validate.validate_inputs(small, "t").collect()}
    assert found == {("error", "too_few_rows", "4"), ("error", "single_target_value", "1"), ("warning", "mostly_null", "e"), ("warning", "target_nulls", "1")}
    assert rows(validate.validate_inputs(small, "zz")) == [("error", "target_missing", "zz")]
    df = spark.range(100).select("id", (F.col("id") % 30).alias("k"), F.col("id").cast("double").alias("d"), F.col("id").cast("string").alias("s"))
    kinds = {c: validate.detect_problem_type(df, c) for c in df.columns}
    assert kinds == {"id": "regression", "k": "regression", "d": "regression", "s": "classification"}
    assert validate.detect_problem_type(df, "s", task="resolution") == "regression"


def test_comparison_shapes(spark):
    df = spark.createDataFrame([(1.0, "a", "u"), (2.0, "a", "v"), (None, None, "u"), (4.0, "b", "u")], "x double, c string, d string")
    assert set(compare.compare_columns(df, "x", "c")) == {"boxplot"}
    assert set(compare.compare_columns(df, "x", "x")) == {"correlation", "scatter"}
    assert rows(compare.crosstab(df, "c", "d").orderBy("c")) == [("a", 1, 1), ("b", 1, 0)]
    with pytest.raises(ValueError, match="combinations"):
        compare.crosstab(df, "c", "d", max_cells=3)
    assert sorted(rows(compare.group_aggregate(df, "c", "x", "SUM"))) == [("a", 3.0), ("b", 4.0)]
    with pytest.raises(ValueError, match="aggregate"):
        compare.group_aggregate(df, "c", "x", "median")
    holes = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 6.0)], "a double, b double")
    matrix = {(r["a"], r["b"]): r["r"] for r in compare.correlation_matrix(holes).collect()}
    assert matrix["a", "b"] == matrix["b", "a"] == pytest.approx(0.99587059)
    assert compare.scatter_sample(spark.range(3000).select("id", (F.col("id") * 2).alias("y")), "id", "y").count() == 1000


def test_cleaning(spark):
    df = spark.createDataFrame(
        [(1, 5, 1.0, "a", None), (1, 5, 1.0, "a", None), (2, 6, None, "b", None), (3, 7, 3.0, None, None)], "ID int, k int, x double, y string, e string",
    )
    cleaned, report = cleaning.clean_table(df, "y")
    assert sorted(rows(cleaned)) == [(5, 1.0, "a"), (6, 1.0, "b")]
    assert rows(report) == [
        ("initial_rows", None, 4), ("initial_columns", None, 5), ("dropped_null_target", "y", 1), ("removed_duplicates", None, 1),
        ("dropped_empty_column", "e", 1), ("dropped_id_column", "ID", 1), ("imputed_median", "x", 1), ("final_rows", None, 2), ("final_columns", None, 3),
    ]


def test_encoding(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "t string, y int")
    assert rows(encoding.one_hot(df)) == [(1, False, True), (2, True, False), (3, False, False)]
    with pytest.raises(ValueError, match="too many"):
        encoding.categories(df, ["t"], max_categories=1)
    coded, labels = encoding.encode_target(df, "t")
    assert labels == ["a", "b"] and [r["t"] for r in coded.collect()] == [1.0, 0.0, None]
    with pytest.raises(ValueError, match="distinct"):
        encoding.label_list(df, "t", limit=1)
    assert rows(encoding.class_balance(df, "t").orderBy("label"))[0][3] == "balanced"
    assert encoding.align_columns(df, ["z", "y"]).first() == (0.0, 1)


def test_transforms(spark):
    df = spark.createDataFrame([(0.0, -1.0), (1.0, 2.0), (100.0, 3.0)], "a double, b double")
    assert transforms.add_variants(df)[1] == ["a_sqrt", "a_log"]
    assert transforms.needs_log(df, "a", "regression") and not transforms.needs_log(df, "a", "classification")
    with pytest.raises(ValueError, match="-1"):
        transforms.needs_log(df.select((F.col("a") - 1).alias("a")), "a", "regression")
    assert transforms.choose_scaler(3, 10) == "robust" and transforms.choose_scaler(2, 10) == "standard" and transforms.choose_scaler(0, 0) == "standard"
    constant = spark.createDataFrame([(2.0,), (2.0,)], "c double")
    assert rows(transforms.standard_scale(constant, ["c"])) == rows(transforms.robust_scale(constant, ["c"])) == [(0.0,), (0.0,)]
    derived = transforms.derive_variants(df, ["b_sqrt", "b_log", "zz_log"])
    assert rows(derived.select("b_sqrt", "b_log"))[0] == (0.0, 0.0) and "zz_log" not in derived.columns


def ticket_rows(spark):
    opened = datetime(2024, 1, 31, 12)
    return spark.createDataFrame(
        [("1", opened, datetime(2024, 1, 1), "new", "high"), ("2", datetime(2024, 1, 30), None, "closed", "low"),
         ("3", datetime(2024, 1, 20), datetime(2024, 2, 2), None, None), ("4", None, datetime(2024, 1, 31, 18), "pending", "medium")],
        "`Case Number` string, `Date Open` timestamp_ntz, `Solution Target` timestamp_ntz, status string, priority string",
    )


def test_dashboard(spark):
    blocks = dashboard.dashboard(ticket_rows(spark))
    summary = blocks["summary"].first()
    assert (summary["open_cases"], summary["overdue_cases"], summary["sla_compliance_pct"]) == (3, 1, 75.0)
    assert [(r["case_id"], r["issue"]) for r in blocks["attention"].collect()] == [
        ("1", "Overdue by 30d"), ("4", "SLA Target due today"), ("3", "SLA Target in 2d"),
    ]
    assert [r["case_id"] for r in blocks["recent"].collect()] == ["2", "3"]
    assert rows(blocks["volume"].select("month", "opened", "closed")) == [("Jan", 3, 1)]
    assert sum(r["this_week"] for r in blocks["weekdays"].collect()) == 2


def test_dashboard_with_missing_columns(spark):
    bare = spark.createDataFrame([("1", datetime(2024, 1, 1)), ("2", datetime(2024, 1, 1))], "`case number` string, `date open` timestamp_ntz")
    blocks = dashboard.dashboard(bare)
    assert blocks["summary"].first()["overdue_cases"] == 0 and blocks["attention"].count() == 0
    assert blocks["recent"].count() == 2  # no case is a day older than the newest, so all are shown
    undated = dashboard.dashboard(spark.createDataFrame([("x",)], "status string"), as_of=datetime(2024, 1, 1))
    assert undated["summary"].first()["open_cases"] == 1 and undated["volume"].count() == 0 and undated["recent"].count() == 0
    empty = dashboard.dashboard(bare.limit(0))
    assert empty["summary"].first()["sla_compliance_pct"] == 100.0


def test_case_filter(spark):
    details = dashboard.case_details(dashboard.bucketed_cases(ticket_rows(spark)))
    ids = lambda **k: sorted(r["case_id"] for r in dashboard.filter_cases(details, **k).collect())
    assert ids(severities=["Critical"]) == ["1"]
    assert ids(start="2024-01-30", end="2024-01-31") == ["1", "2", "4"]
    assert ids(search=" CLOS ") == ["2"] and ids(regions=["EMEA"]) == [] and ids(teams=["N/A"]) == ["1", "2", "3", "4"]


def test_ticket_preparation(spark):
    df = ticket_rows(spark).withColumn("subject", F.lit("router down")).withColumn("product", F.lit("Core"))
    features, target, recipe = tickets.prepare_tickets(df, "resolution")
    assert target == "resolution_hours" and recipe.products == ("Core",)
    assert set(features.columns) == {"hours_open", "resolution_hours", "text_negativity_score", "prod_Core", *recipe.vocabulary.columns}
    assert features.where("hours_open is null").count() == 0 and features.where("resolution_hours is null").count() == 2
    assert "priority" in tickets.prepare_tickets(df, "priority")[0].columns
    with pytest.raises(ValueError, match="case owner"):
        tickets.prepare_tickets(df, "owner")
    with pytest.raises(ValueError, match="task"):
        tickets.prepare_tickets(df, "other")


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "label int, prediction int")
    m = metrics.classification_metrics(df).first()
    assert m["accuracy"] == 0.6 and m["balanced_accuracy"] == 0.5 and m["f1_macro"] == pytest.approx((0.5 + 0.8 + 0) / 3)
    assert m["precision"] == pytest.approx((2 * 0.5 + 2 * 2 / 3) / 5)
    unseen = spark.createDataFrame([(0, 3), (0, 0)], "label int, prediction int")
    assert metrics.classification_metrics(unseen).first()["f1_macro"] == pytest.approx(1 / 3)
    reg = metrics.regression_metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double")).first()
    assert (reg["mae"], reg["rmse"], reg["r2"]) == (0.5, pytest.approx(math.sqrt(0.5)), 0.5)
    with pytest.raises(ValueError, match="regression"):
        metrics.recommend(spark.createDataFrame([("m", 1.0)], "model string, r2 double"), "regression", "f1")
