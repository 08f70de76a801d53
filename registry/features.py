"""Cleaning, encoding, transforms, scaling and feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.operators import cleaning, encoding, selection, transforms
from caseloom.operators.quantiles import exact_quantiles
from caseloom.operators.splits import assign_folds, assign_test
from registry.base import one_row, query, read, rounded, union_all, view

DIRTY_ALL = "case_key, total, urgency, state, patient_id, empty_col, const_col, is_large"


@query("drop_null_target", f"SELECT {DIRTY_ALL} FROM {{dirty}} t WHERE urgency IS NOT NULL")
def null_target(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.drop_null_target(view(spark, sf, "dirty"), "urgency")


@query("drop_duplicates", f"SELECT DISTINCT {DIRTY_ALL} FROM {{dirty}} t")
def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.drop_duplicates(view(spark, sf, "dirty"))


@query("drop_empty_columns", "SELECT case_key, total, urgency, state, patient_id, const_col, is_large FROM {dirty} t")
def without_empty(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.drop_empty_columns(view(spark, sf, "dirty"))


@query("drop_id_columns", "SELECT case_key, total, urgency, state, empty_col, const_col, is_large FROM {dirty} t")
def without_ids(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.drop_id_columns(view(spark, sf, "dirty"))


@query("impute_medians", """
    SELECT case_key, round(coalesce(total, (SELECT median(total) FROM {dirty} m)), 6) AS total, patient_id FROM {dirty} t""")
def imputed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cleaning.impute_medians(view(spark, sf, "dirty").select("case_key", "total", "patient_id")))


CLEAN = "(SELECT DISTINCT * FROM {dirty} t WHERE urgency IS NOT NULL)"


@query("clean_table", f"""
    SELECT case_key, round(coalesce(total, (SELECT median(total) FROM {CLEAN} m)), 6) AS total, urgency, state, const_col, is_large
    FROM {CLEAN} c""")
def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cleaning.clean_table(view(spark, sf, "dirty"), "urgency")[0])


@query("clean_report", f"""
    SELECT 'initial_rows' AS step, NULL AS detail, count(*) AS n FROM {{dirty}} t UNION ALL SELECT 'initial_columns', NULL, 8
    UNION ALL SELECT 'dropped_null_target', 'urgency', count(*) - count(urgency) FROM {{dirty}} t
    UNION ALL SELECT 'removed_duplicates', NULL, (SELECT count(urgency) FROM {{dirty}} t) - count(*) FROM {CLEAN} c
    UNION ALL SELECT 'dropped_empty_column', 'empty_col', 1 UNION ALL SELECT 'dropped_id_column', 'patient_id', 1
    UNION ALL SELECT 'imputed_median', 'total', count(*) - count(total) FROM {CLEAN} c
    UNION ALL SELECT 'final_rows', NULL, count(*) FROM {CLEAN} c UNION ALL SELECT 'final_columns', NULL, 6""")
def report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_table(view(spark, sf, "dirty"), "urgency")[1]


@query("one_hot", """
    SELECT case_key, coalesce(urgency = '1-URGENT', false) AS "urgency_1-URGENT", coalesce(urgency = '2-HIGH', false) AS "urgency_2-HIGH",
      coalesce(urgency = '3-MEDIUM', false) AS "urgency_3-MEDIUM", coalesce(urgency = '4-NOT SPECIFIED', false) AS "urgency_4-NOT SPECIFIED",
      coalesce(urgency = '5-LOW', false) AS "urgency_5-LOW" FROM {dirty} t""")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.one_hot(view(spark, sf, "dirty").select("case_key", "urgency"))


@query("label_codes", "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS code FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)")
def codes(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.label_codes(read(spark, sf, "orders"), "o_orderpriority")


@query("encoded_target", """
    SELECT o_orderkey, CAST(code AS DOUBLE) AS o_orderpriority FROM orders
    JOIN (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS label FROM orders))
    ON label = o_orderpriority""")
def encoded(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_target(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")[0]


@query("fixed_label_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS o_orderstatus FROM orders")
def mapped(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.map_labels(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 1, "O": 0})


@query("log_target", "SELECT event_id, value, round(ln(1 + value), 6) AS value_log FROM events")
def logged(spark: SparkSession, sf: str) -> DataFrame:
    """events.value is skewed, so a log column is added."""
    return rounded(transforms.log_target(read(spark, sf, "events").select("event_id", "value"), "value")[0])


@query("log_guard", "SELECT 'value' AS target, count(*) FILTER (value - 10 <= -1) > 0 AS refused FROM events")
def log_guard(spark: SparkSession, sf: str) -> DataFrame:
    """A skewed target with values <= -1 is refused."""
    shifted = read(spark, sf, "events").select((F.col("value") - 10).alias("value"))
    try:
        transforms.log_target(shifted, "value")
        refused = False
    except ValueError:
        refused = True
    return one_row(spark, target="value", refused=refused)


@query("numeric_variants", """
    SELECT l_quantity, l_discount, l_quantity - 25 AS shifted, round(sqrt(l_quantity), 6) AS l_quantity_sqrt,
      round(ln(1 + l_quantity), 6) AS l_quantity_log, round(sqrt(l_discount), 6) AS l_discount_sqrt,
      round(ln(1 + l_discount), 6) AS l_discount_log FROM lineitem""")
def variants(spark: SparkSession, sf: str) -> DataFrame:
    """A column with negative values gets none."""
    lines = read(spark, sf, "lineitem").select("l_quantity", "l_discount", (F.col("l_quantity") - 25).alias("shifted"))
    return rounded(transforms.add_variants(lines)[0])


@query("scoring_variants", """
    SELECT l_quantity - 25 AS shifted, round(CASE WHEN l_quantity >= 25 THEN sqrt(l_quantity - 25) ELSE 0 END, 6) AS shifted_sqrt,
      round(CASE WHEN l_quantity >= 25 THEN ln(l_quantity - 24) ELSE 0 END, 6) AS shifted_log FROM lineitem""")
def scoring_variants(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select((F.col("l_quantity") - 25).alias("shifted"))
    return rounded(transforms.derive_variants(lines, ["shifted", "shifted_sqrt", "shifted_log"]))


def information_sql(features, target: str) -> str:
    """Plug-in mutual information over decile bins of each feature."""
    edges = [i / 10 for i in range(1, 10)]
    parts = []
    for f in features:
        cuts = ", ".join(f"quantile_cont({f}, {e})" for e in edges)
        parts.append(f"""
          SELECT '{f}' AS feature, len(list_filter(list_distinct(e), lambda c: {f} > c)) AS x, {target} AS y, count(*)::DOUBLE AS n
          FROM {{lines}} l, (SELECT [{cuts}] AS e FROM {{lines}} q) c GROUP BY 1, 2, 3""")
    joint = union_all([f"SELECT * FROM ({p})" for p in parts])
    return f"""
      WITH joint AS ({joint}),
      full_joint AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, x) AS nx,
        sum(n) OVER (PARTITION BY feature, y) AS ny FROM joint)
      SELECT feature, greatest(sum(n / t * ln(n * t / (nx * ny))), 0) AS mi FROM full_joint GROUP BY feature"""


MI_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
MI_SQL = information_sql(MI_FEATURES, "outcome")


@query("mutual_information", f"SELECT feature, round(mi, 6) AS mi FROM ({MI_SQL})")
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.mutual_information(view(spark, sf, "lines"), MI_FEATURES, "outcome", True))


@query("permutation_threshold")
def permutation_threshold(spark: SparkSession, sf: str) -> DataFrame:
    joint = selection.joint_counts(view(spark, sf, "lines"), MI_FEATURES, "outcome", True)
    return selection.noise_threshold(joint)


@query("selected_features")
def selected(spark: SparkSession, sf: str) -> DataFrame:
    kept, dropped = selection.select_features(view(spark, sf, "lines"), MI_FEATURES, "outcome", True)
    rows = [(f, True) for f in kept] + [(f, False) for f in dropped]
    return spark.createDataFrame(rows, "feature string, kept boolean")


@query("aligned_columns", "SELECT l_tax, 0.0::DOUBLE AS absent, l_quantity FROM lineitem")
def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.align_columns(read(spark, sf, "lineitem"), ["l_tax", "absent", "l_quantity"])


def balance_sql(table: str, target: str) -> str:
    return f"""
      WITH c AS (SELECT {target} AS label, count(*) AS n FROM {table} t WHERE {target} IS NOT NULL GROUP BY 1),
      t AS (SELECT sum(n) AS total, min(n) AS least FROM c)
      SELECT label, n, round(n * 100.0 / total, 6)::DOUBLE AS pct, CASE WHEN least * 100.0 / total < 10 THEN 'severe'
        WHEN least * 100.0 / total < 30 THEN 'mild' ELSE 'balanced' END AS verdict FROM c, t"""


@query("class_balance", balance_sql("labels", "toxic"))
def balance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(encoding.class_balance(read(spark, sf, "labels"), "toxic"))


@query("class_weights", """
    SELECT toxic AS label, round((SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)), 6) AS weight
    FROM labels GROUP BY 1""")
def weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(encoding.class_weights(read(spark, sf, "labels"), "toxic"))


@query("weighted_rows", """
    SELECT doc_id, round((SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT toxic) FROM labels) *
      count(*) OVER (PARTITION BY toxic)), 6) AS weight FROM labels""")
def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(encoding.with_class_weights(read(spark, sf, "labels").select("doc_id", "toxic"), "toxic").drop("toxic"))


@query("outlier_summary", union_all([
    f"""SELECT '{c}' AS "column", count(*) AS n_outliers FROM {t},
      (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}) q
      WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0"""
    for t, c in (("events", "value"), ("events", "user_id"), ("events", "event_id"))
]))
def outliers(spark: SparkSession, sf: str) -> DataFrame:
    return transforms.outlier_counts(read(spark, sf, "events"))


@query("scaler_choice", """
    SELECT CASE WHEN (SELECT count(*) FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q
      WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) > 0 THEN 'robust' ELSE 'standard' END AS scaler""")
def scaler(spark: SparkSession, sf: str) -> DataFrame:
    """One of three columns with outliers is more than 30 %."""
    found = transforms.outlier_counts(read(spark, sf, "events")).count()
    return one_row(spark, scaler=transforms.choose_scaler(found, 3))


@query("standard_scaling", """
    SELECT round((l_quantity - q) / qs, 6) AS l_quantity, round((l_extendedprice - p) / ps, 6) AS l_extendedprice
    FROM lineitem, (SELECT avg(l_quantity) AS q, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS p,
      stddev_pop(l_extendedprice) AS ps FROM lineitem) s""")
def standard(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    return rounded(transforms.standard_scale(lines, lines.columns))


@query("robust_scaling", """
    SELECT round((l_quantity - q) / qs, 6) AS l_quantity, round((l_extendedprice - p) / ps, 6) AS l_extendedprice
    FROM lineitem, (SELECT median(l_quantity) AS q, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS qs,
      median(l_extendedprice) AS p, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS ps FROM lineitem) s""")
def robust(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    return rounded(transforms.robust_scale(lines, lines.columns))


@query("threshold_flags", """
    SELECT event_id, CAST(value >= 30 AS INT) AS high_value, CAST(user_id >= 100 AS INT) AS late_user,
      CAST(value >= 30 OR user_id >= 100 AS INT) AS any_flag FROM events""")
def flags(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    flagged = cleaning.threshold_flags(events, {"high_value": ("value", 30), "late_user": ("user_id", 100)}, "any_flag")
    return flagged.select("event_id", "high_value", "late_user", "any_flag")


@query("narrowed_quantiles", union_all([
    f"SELECT '{c}' AS name, {p}::DOUBLE AS prob, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"
    for c in ("l_extendedprice", "l_quantity", "l_discount") for p in (0.01, 0.25, 0.5, 0.75, 0.99)
]))
def narrowed(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles by rank narrowing, with a small exact range, as for a table too large for one task."""
    found = exact_quantiles(
        read(spark, sf, "lineitem"), ("l_extendedprice", "l_quantity", "l_discount"), (0.01, 0.25, 0.5, 0.75, 0.99),
        exact_rows=2000,
    )
    rows = [(c, p, round(v, 6)) for c, q in found.items() for p, v in q.items()]
    return spark.createDataFrame(rows, "name string, prob double, value double")


@query("stratified_split", """
    SELECT o_orderstatus, is_test, CASE WHEN is_test THEN CAST(round(n * 0.2) AS BIGINT) ELSE n - CAST(round(n * 0.2) AS BIGINT) END AS n
    FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) c, (VALUES (true), (false)) t(is_test)""")
def stratified(spark: SparkSession, sf: str) -> DataFrame:
    """Class sizes on both sides of a stratified split."""
    marked = assign_test(read(spark, sf, "orders"), 0.2, stratify="o_orderstatus")
    return marked.groupBy("o_orderstatus", "is_test").agg(F.count("*").alias("n"))


@query("random_split", """
    SELECT is_test, CASE WHEN is_test THEN CAST(round(n * 0.25) AS BIGINT) ELSE n - CAST(round(n * 0.25) AS BIGINT) END AS n
    FROM (SELECT count(*) AS n FROM orders) c, (VALUES (true), (false)) t(is_test)""")
def random_split(spark: SparkSession, sf: str) -> DataFrame:
    return assign_test(read(spark, sf, "orders"), 0.25).groupBy("is_test").agg(F.count("*").alias("n"))


@query("stratified_folds", """
    SELECT o_orderstatus, CAST(f AS INT) AS fold, CAST(round(n * ((f + 1) / 5.0)) AS BIGINT) - CAST(round(n * (f / 5.0)) AS BIGINT) AS n
    FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) c, (SELECT unnest(range(5)) AS f) k""")
def folds(spark: SparkSession, sf: str) -> DataFrame:
    marked = assign_folds(read(spark, sf, "orders"), 5, stratify="o_orderstatus")
    return marked.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


