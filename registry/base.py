"""The registry and the shared input views.

A view is one SQL text that both engines run; `{name}` stands for a table of that name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.columns import col
from caseloom.sources.tables import spread_rows

Run = Callable[[SparkSession, str], DataFrame]
_RUNS: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; `sql` may use `{view}` for the views below."""
    def add(run: Run) -> Run:
        if name in _RUNS:
            raise ValueError(f"query {name!r} is registered twice")
        _RUNS[name] = run
        if sql is not None:
            _SQL[name] = expand(sql)
        return run

    return add


def queries() -> dict[str, Run]:
    return dict(_RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def read_spread(spark: SparkSession, sf: str, table: str = "documents") -> DataFrame:
    """A table for heavy work per row, spread over the cores where its file has few row groups."""
    return spread_rows(read(spark, sf, table))


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

#: The numeric columns of order lines.
LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")

VIEWS = {
    # Support tickets made from orders: mixed-case and padded texts, missing status, priority and target.
    "cases": """
        SELECT o_orderkey AS case_number,
          o_orderdate + (o_custkey % 24) * INTERVAL '1' HOUR AS date_open,
          o_orderdate + (o_custkey % 24 + o_orderkey % 8 + 1) * INTERVAL '1' HOUR AS call_back_target,
          CASE WHEN o_totalprice < 40000 THEN NULL
               ELSE o_orderdate + ((o_orderkey % 20) * 24 + 30) * INTERVAL '1' HOUR END AS solution_target,
          CASE WHEN o_orderstatus = 'F' THEN 'Closed'
               WHEN o_orderstatus = 'P' THEN ' PENDING customer'
               WHEN o_orderpriority = '1-URGENT' THEN 'Escalated to L3'
               WHEN o_orderpriority = '2-HIGH' THEN 'Resolved'
               WHEN o_orderpriority = '3-MEDIUM' THEN NULL
               ELSE 'In Progress' END AS status,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
               WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN ' low ' ELSE NULL END AS priority,
          concat('owner ', CAST(o_custkey % 12 AS STRING)) AS case_owner
        FROM {orders}""",
    # The same with contact, subject, description and product from the other tables.
    "full_cases": """
        SELECT c.*, u.c_name AS contact_name, e.event_type AS subject, e.props AS descr, p.p_type AS product
        FROM {cases} c JOIN {orders} o ON o.o_orderkey = c.case_number
        LEFT JOIN {customer} u ON u.c_custkey = o.o_custkey
        LEFT JOIN {events} e ON e.event_id = o.o_orderkey
        LEFT JOIN {part} p ON p.p_partkey = o.o_custkey""",
    # Orders with missing values, an empty and a constant column, an ID column and repeated rows.
    "dirty": """
        SELECT o_orderkey AS case_key,
          CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS total,
          CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS urgency,
          o_orderstatus AS state, o_custkey AS patient_id, CAST(NULL AS DOUBLE) AS empty_col,
          1 AS const_col, o_totalprice > 250000 AS is_large
        FROM {orders}
        UNION ALL
        SELECT o_orderkey,
          CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END,
          CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END,
          o_orderstatus, o_custkey, CAST(NULL AS DOUBLE), 1, o_totalprice > 250000
        FROM {orders} WHERE o_totalprice > 450000""",
    # A learnable two-class target over order lines.
    "lines": """
        SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
          CASE WHEN l_quantity * (1 - l_discount) + (l_orderkey % 7) > 27 THEN 'late' ELSE 'ok' END AS outcome
        FROM {lineitem}""",
    # Fixed predictions for the metrics.
    "predicted": """
        SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label,
          CASE WHEN l_quantity * (1 - l_discount) > 25 THEN 1 ELSE 0 END AS prediction,
          l_quantity / 50 AS score, l_returnflag AS flag, l_linestatus AS line_status
        FROM {lineitem}""",
}


def _fill(text: str, name: Callable[[str], str]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: name(m.group(1)), text)


def expand(sql: str) -> str:
    """SQL for the checking engine: views become subqueries, tables their names."""
    def name(key: str) -> str:
        return f"({expand(VIEWS[key])})" if key in VIEWS else key

    return _fill(sql, name)


def view(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """A view as a DataFrame, over the tables of `sf`."""
    inlined = expand(VIEWS[key])
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", inlined)]
    text = re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", inlined)
    return spark.sql(text, **{t: read(spark, sf, t) for t in used})


def tickets(spark: SparkSession, sf: str, key: str = "cases") -> DataFrame:
    """A case view under the ticket column names."""
    cases = view(spark, sf, key)
    return cases.toDF(*["desc" if c == "descr" else c.replace("_", " ") for c in cases.columns])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(col(c), digits).alias(c) if t in ("double", "float") else col(c) for c, t in df.dtypes
    ])


def one_row(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema)


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
