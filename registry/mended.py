"""Queries for cases that easily go wrong: rare flags, many values, infinities, written dates, repeated rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.values import parse_timestamp
from caseloom.operators.browse import paginate
from caseloom.operators.compare import correlation_matrix, scatter_sample
from caseloom.operators.encoding import encode_target, one_hot_index
from caseloom.operators.quantiles import exact_quantiles
from caseloom.operators.splits import assign_test
from caseloom.plans.models import RAW, SCALED, scaler_stage
from caseloom.sources.sinks import write_csv
from caseloom.sources.tables import load_table
from registry.base import query, read, rounded, view
from registry.combining import scratch


@query("robust_stage_flags", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS returned,
      round(avg(CASE WHEN l_linenumber = 7 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rare
    FROM lineitem GROUP BY ALL""")
def robust_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags set in a few rows keep their values in the robust scaler of the models: median 0, divided by 1."""
    lines = read(spark, sf, "lineitem")
    flags = [(F.col("l_returnflag") == "R").cast("double"), (F.col("l_linenumber") == 7).cast("double")]
    raw = lines.select("l_returnflag", "l_linestatus", array_to_vector(F.array("l_quantity", *flags)).alias(RAW))
    scaled = scaler_stage("robust").fit(raw).transform(raw)
    values = scaled.select("l_returnflag", "l_linestatus", vector_to_array(SCALED).alias("v"))
    least = values.agg(F.min(F.col("v")[1]).alias("a"), F.max(F.col("v")[1]).alias("b"), F.min(F.col("v")[2]).alias("c")).first()
    on = F.round((F.col("v")[1] - least["a"]) / F.lit(least["b"] - least["a"]), 9)
    return rounded(values.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.avg(on).alias("returned"), F.avg(F.col("v")[2] - least["c"]).alias("rare")))


@query("one_hot_of_names", """
    SELECT c_custkey, c_name, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS c_name_index FROM customer""")
def one_hot_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """One-hot flags of a column with a value per row, in sparse form: each row's flag is its index."""
    return one_hot_index(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_name")[0]


@query("many_labels", """
    SELECT o_custkey, CAST(dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS DOUBLE) AS label FROM orders""")
def many_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A text target with as many labels as rows."""
    return encode_target(read(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("label")), "label")[0]


INFINITE = "CASE WHEN o_orderpriority = '5-LOW' THEN CAST('Infinity' AS DOUBLE) WHEN o_orderstatus = 'P' THEN CAST('-Infinity' AS DOUBLE) ELSE o_totalprice END"


@query("quantiles_beside_infinities", f"""
    SELECT path, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75
    FROM (SELECT {INFINITE} AS v FROM orders) t, (VALUES ('narrowed'), ('whole')) p(path) WHERE isfinite(v) GROUP BY path""")
def infinite_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Infinities are left out whether a column is small enough for one aggregate or its ranks are narrowed."""
    values = read(spark, sf, "orders").select(F.expr(INFINITE).alias("v"))
    probs = [0.25, 0.5, 0.75]
    found = {path: exact_quantiles(values, ["v"], probs, rows)["v"] for path, rows in (("whole", 1 << 62), ("narrowed", 0))}
    rows = [(path, *[q[p] for p in probs]) for path, q in found.items()]
    return rounded(spark.createDataFrame(rows, "path string, q25 double, q50 double, q75 double"))


FORMS = {
    "iso": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), "slashes": ("yyyy/MM/dd", "%Y/%m/%d"), "month_first": ("MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p"),
    "named": ("dd-MMM-yyyy", "%d-%b-%Y"), "long": ("MMM dd, yyyy", "%b %d, %Y"), "short": ("MM/dd/yy", "%m/%d/%y"), "digits": ("yyyyMMdd", "%Y%m%d"),
    "dots": ("dd.MM.yyyy", "%d.%m.%Y"), "minutes": ("yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M"), "offset": ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "%Y-%m-%dT%H:%M:%S+02:00"),
}
DAY_ONLY = ("slashes", "named", "long", "short", "digits", "dots")


@query("written_dates", " UNION ALL ".join(f"""
    SELECT '{name}' AS form, count(*) AS n, count(*) AS parsed,
      CAST(sum(date_diff('second', TIMESTAMP '2000-01-01', {'date_trunc(' + repr('day') + ', ts)' if name in DAY_ONLY else 'date_trunc(' + repr('minute') + ', ts)' if name in ('month_first', 'minutes') else 'date_trunc(' + repr('second') + ', ts)'}
        {"- INTERVAL '2' HOUR" if name == 'offset' else ''})) AS BIGINT) AS seconds
    FROM events""" for name in FORMS))
def written_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Event times written in ten forms and read back; the last has an offset from UTC."""
    times = read(spark, sf, "events").select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("form"), F.date_format("ts", form).alias("text")) for name, (form, _) in FORMS.items()])).alias("w"))
    parsed = times.select("w.form", parse_timestamp(F.col("w.text")).alias("at"))
    seconds = F.timestamp_diff("SECOND", F.lit("2000-01-01").cast("timestamp_ntz"), F.col("at"))
    return parsed.groupBy("form").agg(F.count("*").alias("n"), F.count("at").alias("parsed"), F.sum(seconds).alias("seconds"))


@query("csv_line_breaks", """
    SELECT doc_id, md5(text) AS digest, length(text) AS chars FROM documents""")
def csv_line_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with line breaks, written as CSV and read back."""
    path = write_csv(read(spark, sf, "documents").select("doc_id", "text"), scratch(spark, "texts.csv"))
    back = load_table(spark, path, "csv", schema="doc_id bigint, text string")
    return back.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query("split_of_repeated_rows", """
    SELECT count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS test_rows FROM orders""")
def split_of_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """The share of a split is exact where a table has few distinct rows."""
    marked = assign_test(read(spark, sf, "orders").select("o_orderstatus"), 0.2)
    return marked.agg(F.count("*").alias("n"), F.count_if("is_test").alias("test_rows"))


@query("scatter_of_repeated_pairs", """
    SELECT least(1000, count(*)) AS drawn, 0::BIGINT AS unknown, true AS varied, true AS not_overdrawn FROM lineitem""")
def scatter_of_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of pairs that repeat: all are in the table, none is drawn more often than it occurs, and many differ."""
    lines = read(spark, sf, "lineitem")
    drawn = scatter_sample(lines, "l_quantity", "l_discount").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("d"))
    have = lines.groupBy("l_quantity", "l_discount").agg(F.count("*").alias("h"))
    return drawn.join(have, ["l_quantity", "l_discount"], "left").agg(
        F.sum("d").alias("drawn"), F.count_if(F.col("h").isNull()).alias("unknown"), (F.count("*") > F.sum("d") / 4).alias("varied"),
        F.coalesce(F.bool_and(F.col("d") <= F.col("h")), F.lit(False)).alias("not_overdrawn"))


@query("deep_page_by_date", """
    SELECT l_shipdate, l_orderkey FROM lineitem ORDER BY l_shipdate, l_orderkey LIMIT 15 OFFSET 3000""")
def deep_page_by_date(spark: SparkSession, sf: str) -> DataFrame:
    """A page deep in the order of a date, found by counting."""
    return paginate(read(spark, sf, "lineitem").select("l_shipdate", "l_orderkey"), ["l_shipdate", "l_orderkey"], 201, 15, deep=1000)


@query("correlation_matrix_missing", """
    WITH t AS (SELECT case_key, total, o.o_custkey FROM {dirty} d JOIN {orders} o ON o.o_orderkey = d.case_key)
    SELECT 'case_key' AS a, 'total' AS b, round(corr(case_key, total), 6) AS r FROM t WHERE total IS NOT NULL
    UNION ALL SELECT 'total', 'case_key', round(corr(case_key, total), 6) FROM t WHERE total IS NOT NULL
    UNION ALL SELECT 'case_key', 'case_key', 1.0 UNION ALL SELECT 'total', 'total', 1.0
    UNION ALL SELECT a, b, NULL FROM (VALUES ('const_col', 'const_col'), ('const_col', 'total'), ('total', 'const_col'), ('const_col', 'case_key'), ('case_key', 'const_col')) v(a, b)""")
def correlation_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair over its own complete rows; a constant column has no correlation."""
    return rounded(correlation_matrix(view(spark, sf, "dirty"), ["case_key", "total", "const_col"]))
