"""SLA dashboard, ticket dates and due-date priorities."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.values import due_priority, parse_day_first, whole_days_between
from caseloom.operators.dashboard import (
    attention_cases, bucketed_cases, case_details, case_distribution, daily_rollup, dashboard, filter_cases,
    monthly_volume, recent_cases, sla_summary, status_share, weekday_priorities, weekday_volume,
)
from caseloom.operators.browse import paginate
from caseloom.operators.stored_rollup import append_cases, rollup_at
from caseloom.operators.tickets import parse_dates
from caseloom.session import checkpoint_folder
from registry.base import query, read, tickets

STATUS = """CASE WHEN regexp_matches(s, 'closed|resolved|completed|finished') THEN 'Closed' WHEN contains(s, 'escalat') THEN 'Escalated'
  WHEN contains(s, 'pending') THEN 'Pending' ELSE 'Open' END"""
PRIORITY = "CASE WHEN p IN ('critical', 'high') THEN 'High' WHEN p = 'medium' THEN 'Medium' ELSE 'Low' END"


def bucketed_sql(key: str) -> str:
    """A view with buckets, reference date and overdue flag, as `b`."""
    return f"""
      WITH b AS (
        SELECT *, sb <> 'Closed' AND solution_target IS NOT NULL AND solution_target < ref AS overdue,
          date_diff('microsecond', date_open, solution_target) / 3.6e9 AS hours
        FROM (SELECT *, {STATUS} AS sb, {PRIORITY} AS pb, (SELECT max(date_open) FROM {{{key}}} r) AS ref
              FROM (SELECT *, lower(trim(coalesce(status, ''))) AS s, lower(trim(coalesce(priority, ''))) AS p FROM {{{key}}} c) x) y)"""


CASES, FULL = bucketed_sql("cases"), bucketed_sql("full_cases")
DETAIL = """CAST(case_number AS VARCHAR) AS case_id, {subject} AS subject, sb AS status, pb AS priority,
  strftime(date_open, '%Y-%m-%d %H:%M') AS date_open,
  coalesce(strftime(solution_target, '%Y-%m-%d %H:%M'), 'N/A') AS solution_target,
  {contact} AS contact_name, case_owner, {desc} AS "desc", {product} AS product"""
FULL_DETAIL = DETAIL.format(
    subject="coalesce(subject, 'N/A')", contact="coalesce(contact_name, 'N/A')", desc="coalesce(descr, 'N/A')",
    product="coalesce(product, 'N/A')",
)
DAYS = "(VALUES (0, 'Mon'), (1, 'Tue'), (2, 'Wed'), (3, 'Thu'), (4, 'Fri'), (5, 'Sat'), (6, 'Sun')) d(i, day)"

#: Reference dates of the stored rollup: a time of day, a midnight and one after all cases.
REFERENCES = ("1995-06-17 05:00:00", "1997-01-01 00:00:00", "2030-01-01 12:30:00")
SEEN_FROM = "(VALUES " + ", ".join(f"(TIMESTAMP '{at}')" for at in REFERENCES) + ") t(ref)"


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return daily_rollup(bucketed_cases(tickets(spark, sf)))


@query("case_buckets", CASES + " SELECT case_number, sb AS status_bucket, pb AS priority_bucket, ref FROM b")
def case_buckets(spark: SparkSession, sf: str) -> DataFrame:
    cases = bucketed_cases(tickets(spark, sf))
    return cases.select(F.col("case number").alias("case_number"), "status_bucket", "priority_bucket", "ref")


@query("daily_rollup", CASES + """
    SELECT CAST(date_open AS DATE) AS day,
      CASE WHEN date_open >= ref - INTERVAL 7 DAY THEN 'this' WHEN date_open >= ref - INTERVAL 14 DAY THEN 'last' END AS week,
      sb AS status_bucket, pb AS priority_bucket, count(*) AS n, count(*) FILTER (overdue) AS overdue,
      round(sum(hours), 4) AS hours, count(hours) AS timed FROM b GROUP BY 1, 2, 3, 4""")
def rollup_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rollup(spark, sf).withColumn("hours", F.round("hours", 4))


SUMMARY = CASES + """
    SELECT count(*) FILTER (sb <> 'Closed') AS open_cases, count(*) FILTER (overdue) AS overdue_cases,
      coalesce(round_even(avg(hours) FILTER (sb = 'Closed'), 1), 0.0) AS avg_resolution_hours,
      round_even(100.0::DOUBLE * (1.0::DOUBLE - count(*) FILTER (overdue)::DOUBLE / count(*)), 1) AS sla_compliance_pct,
      0 AS open_cases_trend, 0 AS overdue_cases_trend, 0.0::DOUBLE AS avg_resolution_trend, 0 AS sla_compliance_trend FROM b"""


@query("sla_summary", SUMMARY)
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return sla_summary(rollup(spark, sf))


def stored_cases(spark: SparkSession, sf: str) -> str:
    """All cases, appended to a new store in three parts."""
    path, cases = f"{checkpoint_folder(spark)}/rollup-{uuid4().hex}", tickets(spark, sf)
    for part in range(3):
        append_cases(cases.where(F.pmod(F.col("case number"), F.lit(3)) == part), path, f"part-{part}")
    return path


@query("stored_sla_summary", SUMMARY)
def stored_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The summary from a stored rollup to which the cases were appended in three parts."""
    return sla_summary(rollup_at(spark, stored_cases(spark, sf)))


@query("stored_weekday_volume", CASES + f"""
    SELECT CAST(t.ref AS VARCHAR) AS seen_from, day, count(date_open) FILTER (date_open >= t.ref - INTERVAL 7 DAY) AS this_week,
      count(date_open) FILTER (date_open >= t.ref - INTERVAL 14 DAY AND date_open < t.ref - INTERVAL 7 DAY) AS last_week
    FROM {DAYS} CROSS JOIN {SEEN_FROM} LEFT JOIN (SELECT date_open FROM b) b ON strftime(date_open, '%a') = day GROUP BY ALL""")
def stored_weekdays(spark: SparkSession, sf: str) -> DataFrame:
    path = stored_cases(spark, sf)
    return reduce(DataFrame.unionByName, [
        weekday_volume(rollup_at(spark, path, datetime.fromisoformat(at))).withColumn("seen_from", F.lit(at)) for at in REFERENCES])


@query("stored_summary_by_date", CASES + f"""
    SELECT CAST(t.ref AS VARCHAR) AS seen_from, count(*) FILTER (sb <> 'Closed') AS open_cases,
      count(*) FILTER (sb <> 'Closed' AND solution_target < t.ref) AS overdue_cases,
      round_even(100.0::DOUBLE * (1.0::DOUBLE - count(*) FILTER (sb <> 'Closed' AND solution_target < t.ref)::DOUBLE / count(*)), 1) AS sla_compliance_pct
    FROM b CROSS JOIN {SEEN_FROM} GROUP BY 1""")
def stored_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The figures for three reference dates from one stored table; the cases are read once."""
    path = stored_cases(spark, sf)
    return reduce(DataFrame.unionByName, [
        sla_summary(rollup_at(spark, path, datetime.fromisoformat(at))).select(
            F.lit(at).alias("seen_from"), "open_cases", "overdue_cases", "sla_compliance_pct") for at in REFERENCES])


@query("case_distribution", CASES + """
    SELECT 'Overdue' AS name, count(*) FILTER (overdue) AS value FROM b
    UNION ALL SELECT 'Pending', count(*) FILTER (sb = 'Pending') FROM b
    UNION ALL SELECT 'Closed', count(*) FILTER (sb = 'Closed') FROM b
    UNION ALL SELECT 'Open', count(*) FILTER (sb = 'Open') FROM b""")
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    return case_distribution(rollup(spark, sf))


@query("weekday_volume", CASES + f"""
    SELECT day, count(date_open) FILTER (date_open >= ref - INTERVAL 7 DAY) AS this_week,
      count(date_open) FILTER (date_open >= ref - INTERVAL 14 DAY AND date_open < ref - INTERVAL 7 DAY) AS last_week
    FROM {DAYS} LEFT JOIN b ON strftime(date_open, '%a') = day GROUP BY day""")
def weekdays(spark: SparkSession, sf: str) -> DataFrame:
    return weekday_volume(rollup(spark, sf))


@query("weekday_priorities", CASES + f"""
    SELECT day, count(*) FILTER (pb = 'High') AS high, count(*) FILTER (pb = 'Medium') AS medium,
      count(*) FILTER (pb = 'Low') AS low
    FROM {DAYS} LEFT JOIN b ON strftime(date_open, '%a') = day GROUP BY day""")
def priorities_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return weekday_priorities(rollup(spark, sf))


@query("status_share", CASES + """
    SELECT sb AS name, count(*) AS value, CAST(floor(count(*) * 100.0 / (SELECT count(*) FROM b) + 0.5) AS BIGINT) AS pct
    FROM b GROUP BY sb""")
def shares(spark: SparkSession, sf: str) -> DataFrame:
    return status_share(rollup(spark, sf))


@query("monthly_volume", CASES + """
    SELECT CAST(date_trunc('month', date_open) AS DATE) AS month_start, strftime(date_trunc('month', date_open), '%b') AS month,
      count(*) AS opened, count(*) FILTER (sb = 'Closed') AS closed FROM b GROUP BY 1, 2 ORDER BY 1 DESC LIMIT 6""")
def months(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_volume(rollup(spark, sf))


@query("recent_cases", FULL + f"""
    SELECT {FULL_DETAIL}, strftime(date_open, '%Y-%m-%d') AS last_updated
    FROM (SELECT * FROM b WHERE b.date_open <= ref - INTERVAL 1 DAY ORDER BY b.date_open DESC, case_number LIMIT 5) b""")
def recent(spark: SparkSession, sf: str) -> DataFrame:
    return recent_cases(bucketed_cases(tickets(spark, sf, "full_cases")))


ATTENTION = FULL + f"""
    SELECT {FULL_DETAIL}, CASE WHEN d < 0 THEN concat('Overdue by ', CAST(-d AS VARCHAR), 'd') WHEN d = 0 THEN 'SLA Target due today'
      ELSE concat('SLA Target in ', CAST(d AS VARCHAR), 'd') END AS issue
    FROM (SELECT *, CAST(round_even(date_diff('microsecond', ref, solution_target) / 3.6e9 / 24.0, 0) AS INT) AS d
          FROM b WHERE sb <> 'Closed' AND b.solution_target IS NOT NULL) b"""


@query("attention_cases", ATTENTION)
def attention(spark: SparkSession, sf: str) -> DataFrame:
    return attention_cases(bucketed_cases(tickets(spark, sf, "full_cases")))


@query("attention_page", ATTENTION + " ORDER BY b.solution_target, case_number LIMIT 5 OFFSET 5")
def attention_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of the attention list."""
    cases = bucketed_cases(tickets(spark, sf, "full_cases"))
    urgent = cases.where((F.col("status_bucket") != "Closed") & F.col("solution target").isNotNull())
    return attention_cases(paginate(urgent, ["solution target", "case number"], page=2, size=5))


@query("case_details", FULL + f" SELECT {FULL_DETAIL} FROM b")
def details(spark: SparkSession, sf: str) -> DataFrame:
    return case_details(bucketed_cases(tickets(spark, sf, "full_cases")))


@query("filtered_cases", FULL + f"""
    SELECT {FULL_DETAIL} FROM b
    WHERE b.date_open >= TIMESTAMP '1996-03-01' AND b.date_open < TIMESTAMP '1999-07-01' AND pb IN ('High', 'Low')
      AND case_owner IN ('owner 1', 'owner 4', 'owner 7')
      AND (contains(CAST(case_number AS VARCHAR), 'err') OR contains(coalesce(subject, 'N/A'), 'err') OR contains(lower(sb), 'err')
        OR contains(lower(pb), 'err') OR contains(lower(coalesce(contact_name, 'N/A')), 'err')
        OR contains(case_owner, 'err') OR contains(coalesce(descr, 'N/A'), 'err'))""")
def filtered(spark: SparkSession, sf: str) -> DataFrame:
    cases = case_details(bucketed_cases(tickets(spark, sf, "full_cases")))
    return filter_cases(
        cases, " ERR ", "1996-03-01", "1999-06-30", severities=["Critical", "Low"], teams=["owner 1", "owner 4", "owner 7"]
    )


@query("dashboard_bundle", CASES + """
    SELECT 'open' AS figure, count(*) FILTER (sb <> 'Closed') AS value FROM b
    UNION ALL SELECT 'overdue', count(*) FILTER (overdue) FROM b
    UNION ALL SELECT 'closed', count(*) FILTER (sb = 'Closed') FROM b
    UNION ALL SELECT 'this_week', count(*) FILTER (date_open >= ref - INTERVAL 7 DAY) FROM b
    UNION ALL SELECT 'attention', count(*) FILTER (sb <> 'Closed' AND solution_target IS NOT NULL) FROM b
    UNION ALL SELECT 'recent', least(5, count(*) FILTER (date_open <= ref - INTERVAL 1 DAY)) FROM b
    UNION ALL SELECT 'months', least(6, count(DISTINCT date_trunc('month', date_open))) FROM b""")
def bundle(spark: SparkSession, sf: str) -> DataFrame:
    """One figure of every block of the dashboard."""
    blocks = dashboard(tickets(spark, sf))

    def figure(name: str, df: DataFrame, value) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("value")).select(F.lit(name).alias("figure"), "value")

    parts = [
        figure("open", blocks["summary"], F.sum("open_cases")),
        figure("overdue", blocks["summary"], F.sum("overdue_cases")),
        figure("closed", blocks["distribution"], F.sum(F.when(F.col("name") == "Closed", F.col("value")))),
        figure("this_week", blocks["weekdays"], F.sum("this_week")),
        figure("attention", blocks["attention"], F.count("*")),
        figure("recent", blocks["recent"], F.count("*")),
        figure("months", blocks["volume"], F.count("*")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("parsed_ticket_dates", """
    SELECT o_orderkey AS case_key,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS date_open, o_orderdate AS solution_target
    FROM orders""")
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """ISO and month-first texts; an impossible date becomes NULL."""
    texts = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_key"),
        F.when(F.col("o_orderstatus") == "P", "2024-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("date open"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("solution target"),
    )
    return parse_dates(texts).select(
        "case_key", F.col("`date open`").alias("date_open"), F.col("`solution target`").alias("solution_target")
    )


@query("day_first_dates", """
    SELECT o_orderkey AS case_key, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS parsed FROM orders""")
def day_first(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.when(F.col("o_orderstatus") == "P", "31/02/2024").when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "d/M/yyyy")
    ).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("case_key"), parse_day_first(texts).alias("parsed"))


@query("days_between", """
    SELECT case_number, CAST(floor(date_diff('microsecond', date_open, solution_target) / 8.64e10 + 0.5) AS BIGINT) AS days
    FROM {cases} c""")
def days_between(spark: SparkSession, sf: str) -> DataFrame:
    return tickets(spark, sf).select(
        F.col("case number").alias("case_number"),
        whole_days_between(F.col("date open"), F.col("solution target")).alias("days"),
    )


@query("due_priority", """
    SELECT case_number, CASE WHEN d < 0 THEN 'high' WHEN d <= 7 THEN 'medium' ELSE 'low' END AS due_priority
    FROM (SELECT case_number, floor(date_diff('microsecond', TIMESTAMP '1999-06-15', solution_target) / 8.64e10 + 0.5) AS d
          FROM {cases} c) x""")
def due(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit(datetime(1999, 6, 15).isoformat(" ")).cast("timestamp_ntz")
    return tickets(spark, sf).select(
        F.col("case number").alias("case_number"), due_priority(F.col("solution target"), as_of).alias("due_priority")
    )
