"""Two-column comparison, pivots and exploratory data."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.operators.compare import (
    compare_columns, contingency, correlation, correlation_matrix, crosstab, density_curve, describe_by,
    distinct_values, feature_histograms, group_aggregate, scatter_sample, target_correlations, target_views,
    top_correlated,
)
from caseloom.operators.compare import TOP_FEATURES
from registry.base import LINE_NUMBERS, query, read, rounded, union_all, view
from registry.profiling import bins_sql


@query("pearson_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("scatter_sample")
def scatter(spark: SparkSession, sf: str) -> DataFrame:
    return scatter_sample(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


def describe_sql(source: str, category: str, value: str) -> str:
    return f"""
      SELECT {category}, count({value}) AS count, round(avg({value}), 4) AS mean, round(stddev_samp({value}), 4) AS std,
        min({value}) AS min, round(quantile_cont({value}, 0.25), 4) AS p25, round(quantile_cont({value}, 0.5), 4) AS p50,
        round(quantile_cont({value}, 0.75), 4) AS p75, max({value}) AS max
      FROM {source} t WHERE {category} IS NOT NULL GROUP BY {category}"""


@query("describe_by_category", describe_sql("{dirty}", "urgency", "total"))
def describe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe_by(view(spark, sf, "dirty"), "urgency", "total"), 4)


@query("describe_by_large_group", describe_sql("lineitem", "l_returnflag", "l_extendedprice"))
def describe_large(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe_by(read(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query("contingency_counts", """
    SELECT urgency, state, count(*) AS count FROM {dirty} t WHERE urgency IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2""")
def contingency_counts(spark: SparkSession, sf: str) -> DataFrame:
    return contingency(view(spark, sf, "dirty"), "urgency", "state")


@query("crosstab_wide", """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
      count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def crosstab_wide(spark: SparkSession, sf: str) -> DataFrame:
    return crosstab(read(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


for _how, _sql in (("mean", "avg"), ("sum", "sum"), ("count", "count"), ("min", "min"), ("max", "max")):
    _value = "coalesce(total, 0)" if _how == "sum" else "total"

    @query(f"pivot_{_how}", f"""
        SELECT urgency AS category, round_even(CAST({_sql}({_value}) AS DOUBLE), 2) AS value FROM {{dirty}} t
        WHERE urgency IS NOT NULL GROUP BY 1 HAVING {_sql}({_value}) IS NOT NULL""")
    def pivot(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        return group_aggregate(view(spark, sf, "dirty"), "urgency", "total", how)


@query("correlation_matrix", union_all([
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for a, b in product(LINE_NUMBERS, LINE_NUMBERS)
]))
def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation_matrix(read(spark, sf, "lineitem"), LINE_NUMBERS))


_TARGET_R = union_all([
    f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r FROM lineitem" for c in LINE_NUMBERS if c != "l_extendedprice"
])


@query("target_correlations", f"SELECT feature, round(r, 6) AS r FROM ({_TARGET_R})")
def with_target(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(target_correlations(read(spark, sf, "lineitem"), "l_extendedprice"))


@query("top_correlated_features", f"""
    SELECT feature, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM ({_TARGET_R}) ORDER BY abs(r) DESC, feature LIMIT 6""")
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(top_correlated(read(spark, sf, "lineitem"), "l_extendedprice"))


@query("feature_histograms", union_all([
    f"SELECT * FROM ({bins_sql('lineitem', c, c)})" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
]))
def histograms_of_features(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return rounded(feature_histograms(lines))


@query("density_curve", f"""
    WITH s AS (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events),
    w AS (SELECT *, sd * pow(n, -0.2) AS h FROM s),
    g AS (SELECT i, lo - 3 * h + i * ((hi + 3 * h) - (lo - 3 * h)) / 199 AS x, n, h FROM w, (SELECT unnest(range(200)) AS i)),
    v AS (SELECT value, count(*) AS k FROM events GROUP BY 1)
    SELECT round(x, 6) AS x, round(sum(k * exp(-0.5 * pow((x - value) / h, 2))) / (n * h * {math.sqrt(2 * math.pi)!r}), 6) AS density
    FROM g, v GROUP BY i, x, n, h""")
def density(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(density_curve(read(spark, sf, "events"), "value"))


def _views_sql() -> str:
    names = ("l_extendedprice", "l_discount", "l_tax", "l_quantity")
    return union_all([
        f"SELECT * FROM (SELECT '{c}' AS feature, * FROM ({describe_sql('{lines}', 'outcome_code', c)}) d) x"
        for c in names
    ]).replace("{lines}", "(SELECT *, CASE WHEN outcome = 'late' THEN 1 ELSE 0 END AS outcome_code FROM {lines} y)")


@query("target_box_views", _views_sql())
def target_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Box data of every numeric feature per class of the target."""
    lines = view(spark, sf, "lines").withColumn("outcome_code", F.when(F.col("outcome") == "late", 1).otherwise(0))
    parts = [rounded(d, 4).withColumn("feature", F.lit(c)) for c, d in target_views(lines, "outcome_code", "classification").items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("target_scatter", f"""
    SELECT feature, least(1000, (SELECT count(*) FROM lineitem)) AS drawn, 0::BIGINT AS unknown
    FROM (SELECT feature FROM ({_TARGET_R}) r ORDER BY abs(r) DESC LIMIT {TOP_FEATURES})""")
def target_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """The regression side: for each top feature how many pairs are drawn, and that all of them are pairs of the table."""
    lines, result = read(spark, sf, "lineitem"), None
    for name, pairs in target_views(lines, "l_extendedprice", "regression").items():
        known = lines.select(F.col(name).alias("a"), F.col("l_extendedprice").alias("b")).distinct().withColumn("known", F.lit(True))
        drawn = pairs.toDF("a", "b").join(known, ["a", "b"], "left")
        one = drawn.agg(F.count("*").alias("drawn"), F.count_if(F.col("known").isNull()).alias("unknown")).select(F.lit(name).alias("feature"), "*")
        result = one if result is None else result.unionByName(one)
    return result


@query("column_comparison", describe_sql("orders", "o_orderstatus", "o_totalprice"))
def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compare_columns(read(spark, sf, "orders"), "o_totalprice", "o_orderstatus")["boxplot"], 4)


@query("distinct_values", "SELECT urgency AS value, count(*) AS count FROM {dirty} t GROUP BY 1")
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_values(view(spark, sf, "dirty"), "urgency")
