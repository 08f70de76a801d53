"""Reading, writing, stacking, joining, searching and paging."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from caseloom.functions.columns import guess_roles, map_roles, missing_roles
from caseloom.operators.browse import page_count, paginate, preview, search_rows
from caseloom.operators.combine import join_tables, pick_join_column, stack_tables
from caseloom.operators.hot_keys import join_size
from caseloom.operators.profile import column_stats, dataset_summary
from caseloom.session import checkpoint_folder, cut_lineage
from caseloom.sources.sinks import log_run, run_history, write_csv, write_stats_json
from caseloom.sources.tables import load_table
from registry.base import LINE_NUMBERS, one_row, query, read, union_all, view


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"


@query("csv_source", """
    SELECT o_orderkey AS case_key, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS total,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS urgency, o_totalprice > 250000 AS is_large,
      CASE WHEN o_custkey < 100 THEN NULL ELSE o_custkey END AS customer
    FROM orders""")
def csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as text with NA, n/a and empty fields, and read back with inferred types."""
    o = read(spark, sf, "orders")
    texts = o.select(
        F.col("o_orderkey").cast("string").alias("case_key"),
        F.when(F.col("o_orderpriority") == "5-LOW", "NA").otherwise(F.col("o_totalprice").cast("string")).alias("total"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_orderpriority")).alias("urgency"),
        F.when(F.col("o_totalprice") > 250000, "True").otherwise("False").alias("is_large"),
        F.when(F.col("o_custkey") >= 100, F.col("o_custkey").cast("string")).alias("customer"),
    )
    return load_table(spark, write_csv(texts, scratch(spark, "orders.csv")), "csv")


ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


def info_sql(table: str, types: dict[str, str], extra: str = "") -> str:
    return union_all([
        f"""SELECT {extra} '{c}' AS name, '{t}' AS dtype, count(DISTINCT {c}) AS unique_count,
          (SELECT string_agg(v, '|' ORDER BY k) FROM (
             SELECT DISTINCT {c} AS k, CAST({c} AS VARCHAR) AS v FROM {table} WHERE {c} IS NOT NULL ORDER BY k LIMIT 3)
          ) AS sample_values, count(*) - count({c}) AS missing_count FROM {table}"""
        for c, t in types.items()
    ])


@query("upload_summary", info_sql("orders", ORDER_TYPES, "count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols,"))
def upload_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = dataset_summary(read(spark, sf, "orders"))
    return summary.withColumn("sample_values", F.array_join("sample_values", "|"))


@query("preview_rows", """
    SELECT event_id, user_id, event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS value, props
    FROM events""")
def preview_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All events with infinities, put in for large values, shown as NULL."""
    events = read(spark, sf, "events").withColumn(
        "value", F.when(F.col("value") > 100, F.lit(float("inf"))).otherwise(F.col("value"))
    )
    return preview(events).drop("ts")


@query("preview_first_rows", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 20")
def preview_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return preview(read(spark, sf, "events").select("event_id", "event_type", "value"), 20, "event_id")


@query("search_rows", """
    SELECT * FROM {full_cases} t
    WHERE contains(lower(coalesce(CAST(case_number AS VARCHAR), '')), '12') OR contains(lower(coalesce(status, '')), '12')
      OR contains(lower(coalesce(contact_name, '')), '12') OR contains(lower(coalesce(subject, '')), '12')
      OR contains(lower(coalesce(descr, '')), '12') OR contains(lower(coalesce(product, '')), '12')
      OR contains(lower(coalesce(case_owner, '')), '12') OR contains(lower(coalesce(priority, '')), '12')
      OR contains(CAST(date_open AS VARCHAR), '12') OR contains(CAST(call_back_target AS VARCHAR), '12')
      OR contains(coalesce(CAST(solution_target AS VARCHAR), ''), '12')""")
def search_cases(spark: SparkSession, sf: str) -> DataFrame:
    return search_rows(view(spark, sf, "full_cases"), "12")


@query("search_document_text", "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'und')")
def search_document_text(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents")
    return search_rows(documents.select("text", "doc_id", "lang", "source"), "UND").select("doc_id", "lang", "source")


@query("table_page", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 30")
def table_page(spark: SparkSession, sf: str) -> DataFrame:
    return paginate(read(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], page=3, size=15)


@query("deep_table_page", """
    SELECT * FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_discount, l_tax, l_shipdate LIMIT 15 OFFSET (SELECT (count(*) // 15 - 2) * 15 FROM lineitem)""")
def deep_table_page(spark: SparkSession, sf: str) -> DataFrame:
    """The last full page but one, found by narrowing the key range."""
    lines = read(spark, sf, "lineitem")
    keys = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
            "l_tax", "l_shipdate"]
    return paginate(lines, keys, page=lines.count() // 15 - 1, size=15, deep=1000)


@query("page_count", "SELECT CAST(greatest(1, ceil(count(*) / 15.0)) AS BIGINT) AS total_pages FROM orders")
def total_pages(spark: SparkSession, sf: str) -> DataFrame:
    return one_row(spark, total_pages=page_count(read(spark, sf, "orders"), 15))


@query("stack_tables", """
    SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority, NULL::VARCHAR AS segment
    FROM orders
    UNION ALL SELECT NULL, c_custkey, CAST(floor(c_acctbal) AS DOUBLE), NULL, c_mktsegment FROM customer""")
def stacked(spark: SparkSession, sf: str) -> DataFrame:
    left = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    right = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.floor("c_acctbal").alias("o_totalprice"),
        F.col("c_mktsegment").alias("segment"),
    )
    return stack_tables(left, right)


@query("join_tables", """
    SELECT a.k AS customer_id, a.o_orderkey, a.v AS amount_a, b.v AS amount_b, b.c_mktsegment
    FROM (SELECT CASE WHEN o_orderkey < 20 THEN NULL ELSE o_custkey END AS k, o_orderkey, o_totalprice AS v FROM orders) a
    JOIN (SELECT CASE WHEN c_custkey < 5 THEN NULL ELSE c_custkey END AS k, c_acctbal AS v, c_mktsegment FROM customer) b
    ON a.k IS NOT DISTINCT FROM b.k""")
def joined(spark: SparkSession, sf: str) -> DataFrame:
    """Null keys match each other; the other shared column gets suffixes."""
    left = read(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") >= 20, F.col("o_custkey")).alias("customer_id"), "o_orderkey",
        F.col("o_totalprice").alias("amount"),
    )
    right = read(spark, sf, "customer").select(
        F.when(F.col("c_custkey") >= 5, F.col("c_custkey")).alias("customer_id"), F.col("c_acctbal").alias("amount"),
        "c_mktsegment",
    )
    return join_tables(left, right, on="customer_id", require_match=True)


#: Order lines of which a good half belong to one supplier and some to none, and suppliers of which some lack a key.
HOT_LINES = """SELECT CASE WHEN l_linenumber <= 2 THEN 7 WHEN l_linenumber = 6 AND l_orderkey % 50 = 0 THEN NULL ELSE l_suppkey END AS supplier,
    l_orderkey, l_quantity FROM lineitem"""
SOME_SUPPLIERS = "SELECT CASE WHEN s_suppkey % 5 <> 3 THEN s_suppkey END AS supplier, s_suppkey, s_nationkey FROM supplier"


def hot_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines, suppliers = read(spark, sf, "lineitem"), read(spark, sf, "supplier")
    key = F.when(F.col("l_linenumber") <= 2, 7).when((F.col("l_linenumber") != 6) | (F.col("l_orderkey") % 50 != 0), F.col("l_suppkey"))
    return lines.select(key.alias("supplier"), "l_orderkey", "l_quantity"), suppliers.select(
        F.when(F.col("s_suppkey") % 5 != 3, F.col("s_suppkey")).alias("supplier"), "s_suppkey", "s_nationkey")


@query("join_with_hot_key", f"""
    SELECT b.s_suppkey, a.supplier, count(*) AS n_lines, count(DISTINCT a.l_orderkey) AS n_orders, round(sum(a.l_quantity), 4) AS quantity
    FROM ({HOT_LINES}) a JOIN ({SOME_SUPPLIERS}) b ON a.supplier IS NOT DISTINCT FROM b.supplier GROUP BY 1, 2""")
def hot_join(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the lines share a key and others have none: such keys are found by a sketch and dealt to cells.

    The pairs of missing keys grow with the square of the tables, so they are counted where they meet: one line of each
    key and order, and one row of each supplier, are marked before the join, and orders are the pairs of marked rows.
    """
    lines, suppliers = hot_sides(spark, sf)
    lines = _first_marked(lines, ["supplier", "l_orderkey"], "first_line")
    suppliers = _first_marked(suppliers, ["supplier", "s_suppkey"], "first_row")
    joined = join_tables(lines, suppliers, on="supplier", hot_rows=1000)
    return joined.groupBy("s_suppkey", "supplier").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("first_line") & F.col("first_row") & F.col("l_orderkey").isNotNull()).alias("n_orders"),
        F.round(F.sum("l_quantity"), 4).alias("quantity"))


def _first_marked(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """`rows` with a flag that is true for one row of each key, written so that later passes see the same one."""
    return cut_lineage(rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) == 1))


@query("join_size", f"""
    SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (a.supplier IS NULL) AS BIGINT) AS null_pairs
    FROM ({HOT_LINES}) a JOIN ({SOME_SUPPLIERS}) b ON a.supplier IS NOT DISTINCT FROM b.supplier""")
def size_of_join(spark: SparkSession, sf: str) -> DataFrame:
    return join_size(*hot_sides(spark, sf), "supplier").select(F.col("pairs").cast("bigint"), F.col("null_pairs").cast("bigint"))


@query("join_key_choice", """
    SELECT CASE WHEN (SELECT count(DISTINCT o_orderkey) FROM orders) >= (SELECT count(DISTINCT o_custkey) FROM orders)
      THEN 'o_orderkey' ELSE 'o_custkey' END AS join_column""")
def join_key_choice(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    right = orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return one_row(spark, join_column=pick_join_column(orders, right))


@query("csv_sink", """
    SELECT CAST(n_regionkey AS BIGINT) AS key, n_name AS name_a, r_name AS name_b, count(c_custkey) AS customers
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    """All nations joined with their regions, written as text and read back."""
    customers = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    nation = read(spark, sf, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_regionkey").alias("key"), F.col("n_name").alias("name"), F.coalesce("customers", F.lit(0)).alias("customers")
    )
    region = read(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    path = write_csv(join_tables(nation, region, on="key"), scratch(spark, "nation_region_joined.csv"))
    return load_table(spark, path, "csv").select("key", "name_a", "name_b", "customers")


@query("stats_json_sink", union_all([f"""
    SELECT '{c}' AS name, 'Numeric' AS type, round_even(avg({c}), 2) AS mean, round_even(min({c})::DOUBLE, 2) AS min,
      round_even(max({c})::DOUBLE, 2) AS max, count(DISTINCT {c}) AS unique_count FROM lineitem""" for c in LINE_NUMBERS]))
def stats_json_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of all numeric columns, written as JSON and read back."""
    stats = column_stats(read(spark, sf, "lineitem").select(*LINE_NUMBERS))
    path = write_stats_json(stats, scratch(spark, "stats.json"))
    return load_table(spark, path, "json").select("name", "type", "mean", "min", "max", "unique_count")


@query("run_log", """
    SELECT 'orders' AS dataset, 'o_totalprice' AS target, 'Ridge Regression' AS model, 'r2' AS metric,
      count(*) / 1e6 AS score, 'Completed' AS status FROM orders
    UNION ALL SELECT 'events', 'value', 'Random Forest (Tuned)', 'r2', count(*) / 1e6, 'Completed' FROM events""")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "runs")
    for table, target, model in (("orders", "o_totalprice", "Ridge Regression"), ("events", "value", "Random Forest (Tuned)")):
        log_run(spark, path, table, target, model, "r2", read(spark, sf, table).count() / 1e6)
    return run_history(spark, path).drop("run_id", "date")


@query("role_mapping", """
    SELECT case_number AS caseNumber, subject, contact_name AS contactName, status, date_open AS dateOpen,
      case_owner AS caseOwner, solution_target AS remedyTarget FROM {full_cases} t""")
def role_mapping(spark: SparkSession, sf: str) -> DataFrame:
    cases = view(spark, sf, "full_cases")
    mapping = guess_roles(cases.columns)
    if missing_roles(mapping):
        raise ValueError(f"unmapped roles: {missing_roles(mapping)}")
    return map_roles(cases, mapping)
