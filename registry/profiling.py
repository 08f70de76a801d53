"""Column profiles, alerts, column detail and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.operators.profile import (
    alerts, as_numeric_if_mostly, column_detail, column_info, column_stats, dataset_totals, duplicate_count,
    feature_defaults, feature_info, health_report, numeric_coercion, scoring_schema,
)
from caseloom.operators.encoding import product_flags
from caseloom.operators.validate import detect_problem_type, validate_inputs
from registry.base import LINE_NUMBERS, query, read, rounded, union_all, view
from registry.combining import info_sql

CUSTOMER_TYPES = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
}
LINE_OTHERS = ("l_returnflag", "l_linestatus", "l_shipdate")
DIRTY_NUMBERS = ("case_key", "total", "patient_id", "empty_col", "const_col")
DIRTY_COLUMNS = ("case_key", "total", "urgency", "state", "patient_id", "empty_col", "const_col", "is_large")
DIRTY_TYPES = {
    "case_key": "bigint", "total": "double", "urgency": "string", "state": "string", "patient_id": "bigint",
    "empty_col": "double", "const_col": "int", "is_large": "boolean",
}


@query("column_info", info_sql("customer", CUSTOMER_TYPES))
def customer_info(spark: SparkSession, sf: str) -> DataFrame:
    return column_info(read(spark, sf, "customer")).withColumn("sample_values", F.array_join("sample_values", "|"))


def stats_sql(table: str, columns, numeric, booleans=()) -> str:
    def figures(c: str) -> str:
        if c not in numeric and c not in booleans:
            return "NULL::DOUBLE AS mean, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS median"
        v = f"CAST({c} AS INT)" if c in booleans else c
        return (f"round_even(avg({v}), 2) AS mean, round_even(CAST(min({v}) AS DOUBLE), 2) AS min, "
                f"round_even(CAST(max({v}) AS DOUBLE), 2) AS max, round_even(CAST(median({v}) AS DOUBLE), 2) AS median")

    return union_all([
        f"""SELECT '{c}' AS name, '{"Numeric" if c in numeric or c in booleans else "Categorical"}' AS type,
          round_even((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS missing_pct,
          count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count, {figures(c)} FROM {table} t"""
        for c in columns
    ])


@query("column_stats", stats_sql("lineitem", [*LINE_NUMBERS, *LINE_OTHERS], LINE_NUMBERS))
def line_stats(spark: SparkSession, sf: str) -> DataFrame:
    return column_stats(read(spark, sf, "lineitem"))


@query("column_stats_dirty", stats_sql("{dirty}", DIRTY_COLUMNS, DIRTY_NUMBERS, ("is_large",)))
def dirty_stats(spark: SparkSession, sf: str) -> DataFrame:
    return column_stats(view(spark, sf, "dirty"))


@query("column_stats_approximate")
def approximate_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The one-pass variant with sketches."""
    return column_stats(read(spark, sf, "lineitem"), exact=False)


DUPLICATES = f"""
    SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates
    FROM (SELECT count(*) AS n FROM {{dirty}} t GROUP BY {', '.join(DIRTY_COLUMNS)})"""


@query("quality_alerts", f"""
    WITH t AS (SELECT * FROM {{dirty}} x), n AS (SELECT count(*) AS n FROM t)
    SELECT 'duplicate_rows' AS code, NULL AS "column", CAST(duplicates AS VARCHAR) AS detail
    FROM ({DUPLICATES}) WHERE duplicates > 0 UNION ALL """ + union_all([
        f"""SELECT 'zero_variance', '{c}', CAST(min({c}) AS VARCHAR) FROM t HAVING count(DISTINCT {c}) = 1
        UNION ALL SELECT 'high_missing', '{c}', CAST(round_even((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS VARCHAR)
        FROM t HAVING round_even((count(*) - count({c})) * 100.0 / count(*), 1) > 30""" + (
            "" if c in DIRTY_NUMBERS or c == "is_large" else
            f" UNION ALL SELECT 'unique_text_id', '{c}', CAST(count(*) AS VARCHAR) FROM t HAVING count(DISTINCT {c}) = count(*)")
        for c in DIRTY_COLUMNS
    ]))
def quality_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(view(spark, sf, "dirty"))


@query("unique_text_alert", """
    SELECT 'unique_text_id' AS code, 'c_name' AS "column", CAST(count(*) AS VARCHAR) AS detail FROM customer""")
def unique_text_alert(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(read(spark, sf, "customer"))


@query("dataset_totals", """
    SELECT count(*) AS n_rows, 8::BIGINT AS n_cols, (2 * count(*) - count(total) - count(urgency) + count(*)) AS missing_values,
      5::BIGINT AS numeric_features FROM {dirty} t""")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return dataset_totals(view(spark, sf, "dirty"))


@query("duplicate_rows", DUPLICATES)
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_count(view(spark, sf, "dirty"))


def bins_sql(source: str, value: str, column: str | None = None) -> str:
    """Ten equal-width bins of `value` over the rows of `source`."""
    name = f"'{column}' AS \"column\", " if column else ""
    return f"""
        SELECT {name} CAST(i AS INT) AS bin_idx, round(lo + i * w, 6) AS lo, round(CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * w END, 6) AS hi,
          count(v) AS count
        FROM (SELECT min({value}) AS lo, max({value}) AS hi, (max({value}) - min({value})) / 10 AS w FROM {source} t) e
        CROSS JOIN (SELECT unnest(range(10)) AS i) k
        LEFT JOIN (SELECT {value} AS v FROM {source} t) d
          ON v >= CASE WHEN i = 0 THEN lo ELSE lo + i * w END AND (v < lo + (i + 1) * w OR (i = 9 AND v <= hi))
        GROUP BY lo, hi, w, i"""


@query("numeric_histogram", bins_sql("events", "value"))
def numeric_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(column_detail(read(spark, sf, "events"), "value")["distribution"])


SKEW = "CASE WHEN count({v}) < 3 THEN 0.0 ELSE coalesce(skewness({v}), 0.0) END"


@query("numeric_detail", f"""
    SELECT 'value' AS name, 'Numeric' AS type, round_even({SKEW.format(v="value")}, 2) AS skewness,
      count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers_count,
      count(value) AS total_count
    FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q""")
def numeric_detail(spark: SparkSession, sf: str) -> DataFrame:
    return column_detail(read(spark, sf, "events"), "value")["summary"]


@query("empty_detail", """
    SELECT 'empty_col' AS name, 'Empty' AS type, 0.0::DOUBLE AS skewness, 0::BIGINT AS outliers_count, count(empty_col) AS total_count
    FROM {dirty} t""")
def empty_detail(spark: SparkSession, sf: str) -> DataFrame:
    """A column without values is Empty whatever its type."""
    return column_detail(view(spark, sf, "dirty"), "empty_col")["summary"]


MIXED = "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'n.a.' ELSE CAST(o_totalprice AS VARCHAR) END"


@query("numeric_coercion", f"""
    SELECT count(*) AS n_values, count(TRY_CAST({MIXED} AS DOUBLE)) AS n_numeric,
      count(TRY_CAST({MIXED} AS DOUBLE)) >= 0.8 * count(*) AS is_numeric FROM orders""")
def coercion(spark: SparkSession, sf: str) -> DataFrame:
    return numeric_coercion(read(spark, sf, "orders").select(F.expr(MIXED.replace("VARCHAR", "STRING")).alias("mixed")), "mixed")


@query("coerced_values", f"SELECT v AS value FROM (SELECT TRY_CAST({MIXED} AS DOUBLE) AS v FROM orders) WHERE v IS NOT NULL")
def coerced_values(spark: SparkSession, sf: str) -> DataFrame:
    texts = read(spark, sf, "orders").select(F.expr(MIXED.replace("VARCHAR", "STRING")).alias("mixed"))
    return as_numeric_if_mostly(texts, "mixed")[0]


@query("top_values", """
    SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def most_frequent(spark: SparkSession, sf: str) -> DataFrame:
    texts = read(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("user"))
    return column_detail(texts, "user")["distribution"].withColumn("value", F.expr("substring(value, 2)"))


@query("health_totals", f"""
    SELECT n AS n_rows, 8::BIGINT AS n_cols, m AS missing_cells, round_even(m * 100.0 / (n * 8), 2)::DOUBLE AS missing_pct, duplicates
    FROM (SELECT count(*) AS n, 3 * count(*) - count(total) - count(urgency) AS m FROM {{dirty}} t) a, ({DUPLICATES}) d""")
def health_totals(spark: SparkSession, sf: str) -> DataFrame:
    return health_report(view(spark, sf, "dirty"))["totals"]


@query("health_columns", union_all([
    f"""SELECT '{c}' AS name, '{t}' AS dtype, count(DISTINCT {c}) AS unique_count, count(*) - count({c}) AS missing_count,
      round_even((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS missing_pct, """ + ", ".join(
        f"coalesce(format('{{:.2f}}', CAST({f}({c}) AS DOUBLE)), 'N/A') AS {a}" if c in DIRTY_NUMBERS else f"'-' AS {a}"
        for a, f in (("mean", "avg"), ("min", "min"), ("max", "max"))
    ) + " FROM {dirty} t" for c, t in DIRTY_TYPES.items()
]))
def health_columns(spark: SparkSession, sf: str) -> DataFrame:
    return health_report(view(spark, sf, "dirty"))["columns"]


@query("validation_findings", """
    SELECT 'warning' AS level, 'mostly_null' AS code, 'empty_col' AS detail
    UNION ALL SELECT 'warning', 'target_nulls', CAST(count(*) - count(urgency) AS VARCHAR) FROM {dirty} t
    HAVING count(*) > count(urgency)""")
def validation_findings(spark: SparkSession, sf: str) -> DataFrame:
    return validate_inputs(view(spark, sf, "dirty"), "urgency")


@query("validation_errors", """
    SELECT 'error' AS level, 'single_target_value' AS code, CAST(count(DISTINCT const_col) AS VARCHAR) AS detail FROM {dirty} t
    UNION ALL SELECT 'error', 'no_features', 'const_col'
    UNION ALL SELECT 'error', 'target_missing', 'absent'""")
def validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    dirty = view(spark, sf, "dirty").select("const_col")
    return validate_inputs(dirty, "const_col").unionByName(validate_inputs(dirty, "absent"))


@query("problem_types", """
    SELECT 'o_orderpriority' AS target, 'classification' AS problem_type UNION ALL SELECT 'o_totalprice', 'regression'
    UNION ALL SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) <= 20 OR count(DISTINCT o_custkey) < 0.05 * count(*)
      THEN 'classification' ELSE 'regression' END FROM orders
    UNION ALL SELECT 'o_orderkey', CASE WHEN count(DISTINCT o_orderkey) <= 20 OR count(DISTINCT o_orderkey) < 0.05 * count(*)
      THEN 'classification' ELSE 'regression' END FROM orders""")
def problem_types(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    rows = [(c, detect_problem_type(orders, c)) for c in ("o_orderpriority", "o_totalprice", "o_custkey", "o_orderkey")]
    return spark.createDataFrame(rows, "target string, problem_type string")


@query("feature_info", union_all([
    f"SELECT '{c}' AS name, true AS is_numeric, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"round(avg({c}), 6) AS mean, NULL AS options FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")
] + [
    f"""SELECT '{c}', false, NULL, NULL, NULL, (SELECT string_agg(v, '|' ORDER BY v) FROM
      (SELECT DISTINCT {c} AS v FROM customer ORDER BY v LIMIT 50))""" for c in ("c_name", "c_mktsegment")
]))
def form_fields(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(feature_info(read(spark, sf, "customer")).withColumn("options", F.array_join("options", "|")))


@query("feature_defaults", union_all([
    f"SELECT '{c}' AS name, round(avg({c}), 6) AS number, NULL AS text FROM customer"
    for c in ("c_custkey", "c_nationkey", "c_acctbal")
] + [
    f"SELECT '{c}', NULL, (SELECT {c} FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    for c in ("c_name", "c_mktsegment")
] + ["SELECT 'tfidf_error', 0.0, NULL"]))
def defaults(spark: SparkSession, sf: str) -> DataFrame:
    customers = read(spark, sf, "customer").withColumn("tfidf_error", F.col("c_acctbal") / 2)
    return rounded(feature_defaults(customers))


@query("scoring_form", """
    SELECT 'product' AS name, false AS is_numeric, false AS is_text, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL AS mean,
      (SELECT string_agg(DISTINCT p_type, '|' ORDER BY p_type) FROM part) AS options
    UNION ALL SELECT 'case_description', false, true, NULL, NULL, NULL, NULL
    UNION ALL SELECT 'p_size', true, false, min(p_size)::DOUBLE, max(p_size)::DOUBLE, round(avg(p_size), 6), NULL FROM part""")
def scoring_form(spark: SparkSession, sf: str) -> DataFrame:
    parts = product_flags(read(spark, sf, "part").select("p_size", F.col("p_type").alias("product"))).drop("product")
    fields = scoring_schema(parts.withColumn("text_negativity_score", F.lit(0.0)))
    return rounded(fields.withColumn("options", F.array_join("options", "|")))


