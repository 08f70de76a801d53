"""SLA dashboard figures for a ticket table.

The counted figures all follow from one small daily rollup, so a table is read once for all of them;
the case lists are a top-k or a distributed sort.  The reference date is a scalar subquery over one
column, so no window or join spans the whole table.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import col, normalise_names
from caseloom.functions.values import hours_between, priority_bucket, status_bucket
from caseloom.operators.tickets import parse_dates
from caseloom.session import cut_lineage

# Weekdays and, further below, the texts of the attention list.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
RECENT_CASES = 5
VOLUME_MONTHS = 6
SEARCH_FIELDS = ("case_id", "subject", "status", "priority", "contact_name", "case_owner", "desc", "issue", "region")


def bucketed_cases(df: DataFrame, as_of: datetime | None = None, day_first: bool = False) -> DataFrame:
    """Tickets with parsed dates, `status_bucket`, `priority_bucket` and the reference date `ref`.

    `ref` is the latest opening date, else `as_of`, else the current time.  Missing columns degrade:
    no status is Open, no priority is Low, no target is never overdue.
    """
    cases = parse_dates(normalise_names(df), day_first)
    nothing = F.lit(None).cast("timestamp_ntz")
    extra = [nothing.alias(c) for c in ("date open", "solution target") if c not in cases.columns]
    cases = cases.select("*", *extra) if extra else cases
    status = status_bucket(col("status")) if "status" in cases.columns else F.lit("Open")
    priority = priority_bucket(col("priority")) if "priority" in cases.columns else F.lit("Low")
    fallback = F.lit(as_of) if as_of else F.localtimestamp()
    latest = cases.agg(F.max(col("date open")).alias("ref")).scalar()
    return cases.select(
        "*", status.alias("status_bucket"), priority.alias("priority_bucket"),
        F.coalesce(latest, fallback.cast("timestamp_ntz")).alias("ref"),
    )


def _closed() -> Column:
    return F.col("status_bucket") == "Closed"


def _overdue() -> Column:
    return ~_closed() & col("solution target").isNotNull() & (col("solution target") < F.col("ref"))


def daily_rollup(cases: DataFrame) -> DataFrame:
    """`day, week, status_bucket, priority_bucket, n, overdue, hours, timed`: all the counted figures need.

    The one pass over the cases: counts are combined before the shuffle and the result has a few rows
    per calendar day.  `week` is `this` for the 7 days up to `ref` and `last` for the 7 before.
    """
    opened, ref = col("date open"), F.col("ref")
    hours = hours_between(opened, col("solution target"))
    week = F.when(opened >= ref - F.expr("INTERVAL 7 DAYS"), "this").when(
        opened >= ref - F.expr("INTERVAL 14 DAYS"), "last"
    )
    return cases.groupBy(
        opened.cast("date").alias("day"), week.alias("week"), "status_bucket", "priority_bucket"
    ).agg(
        F.count("*").alias("n"), F.count_if(_overdue()).alias("overdue"),
        F.sum(hours).alias("hours"), F.count(hours).alias("timed"),
    )


def _cases_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")


def sla_summary(rollup: DataFrame) -> DataFrame:
    """One row: open and overdue cases, mean resolution hours of closed ones, SLA compliance, trends (0)."""
    totals = rollup.agg(
        F.sum("n").alias("n"), _cases_where(~_closed()).alias("open_cases"),
        F.coalesce(F.sum("overdue"), F.lit(0)).cast("bigint").alias("overdue_cases"),
        F.try_divide(F.sum(F.when(_closed(), F.col("hours"))), F.sum(F.when(_closed(), F.col("timed")))).alias("hours"),
    )
    kept = 100.0 * (1.0 - F.try_divide(F.col("overdue_cases").cast("double"), F.col("n").cast("double")))
    return totals.select(
        "open_cases", "overdue_cases",
        F.coalesce(F.bround("hours", 1), F.lit(0.0)).alias("avg_resolution_hours"),
        F.coalesce(F.bround(kept, 1), F.lit(100.0)).alias("sla_compliance_pct"),
        F.lit(0).alias("open_cases_trend"), F.lit(0).alias("overdue_cases_trend"),
        F.lit(0.0).alias("avg_resolution_trend"), F.lit(0).alias("sla_compliance_trend"),
    )


def case_distribution(rollup: DataFrame) -> DataFrame:
    """`name, value` for Overdue, Pending, Closed, Open; overdue cases are also in their own status."""
    totals = rollup.agg(
        F.coalesce(F.sum("overdue"), F.lit(0)).cast("bigint").alias("Overdue"),
        *[_cases_where(F.col("status_bucket") == s).alias(s) for s in ("Pending", "Closed", "Open")],
    )
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in totals.columns
    ])))


def _per_weekday(rollup: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """One row per weekday from Monday, zero where no case was opened."""
    counted = rollup.groupBy(F.date_format("day", "E").alias("day")).agg(
        *[_cases_where(condition).alias(name) for name, condition in figures.items()]
    )
    days = rollup.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "ordinal int, day string")
    return days.join(counted, "day", "left").orderBy("ordinal").select(
        "day", *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in figures]
    )


def weekday_volume(rollup: DataFrame) -> DataFrame:
    """`day, this_week, last_week`: cases opened in the last 7 and in the 7 days before `ref`."""
    return _per_weekday(rollup, {"this_week": F.col("week") == "this", "last_week": F.col("week") == "last"})


def weekday_priorities(rollup: DataFrame) -> DataFrame:
    """`day, high, medium, low`: cases opened per weekday and priority."""
    return _per_weekday(rollup, {p.lower(): F.col("priority_bucket") == p for p in ("High", "Medium", "Low")})


def status_share(rollup: DataFrame) -> DataFrame:
    """`name, value, pct`: cases per status bucket and their share in whole percent."""
    counted = rollup.groupBy(F.col("status_bucket").alias("name")).agg(F.sum("n").alias("value"))
    total = rollup.agg(F.sum("n").alias("t")).scalar()
    return counted.select("name", "value", F.floor(F.col("value") * 100.0 / total + 0.5).cast("bigint").alias("pct"))


def monthly_volume(rollup: DataFrame, months: int = VOLUME_MONTHS) -> DataFrame:
    """`month_start, month, opened, closed` of the last months that occur in the data, oldest first."""
    counted = rollup.where(F.col("day").isNotNull()).groupBy(
        F.trunc("day", "month").alias("month_start")
    ).agg(F.sum("n").alias("opened"), _cases_where(_closed()).alias("closed"))
    last = counted.orderBy(F.desc("month_start")).limit(months)
    return last.orderBy("month_start").select(
        "month_start", F.date_format("month_start", "MMM").alias("month"), "opened", "closed"
    )


def case_fields(cases: DataFrame) -> list[Column]:
    """The ten detail fields of a case; what is missing is "N/A"."""
    def text(name: str) -> Column:
        return F.coalesce(col(name).cast("string"), F.lit("N/A")) if name in cases.columns else F.lit("N/A")

    def time(name: str) -> Column:
        return F.coalesce(F.substring(col(name).cast("string"), 1, 16), F.lit("N/A"))

    return [
        text("case number").alias("case_id"), text("subject").alias("subject"),
        F.col("status_bucket").alias("status"), F.col("priority_bucket").alias("priority"),
        time("date open").alias("date_open"), time("solution target").alias("solution_target"),
        text("contact name").alias("contact_name"), text("case owner").alias("case_owner"),
        text("desc").alias("desc"), text("product").alias("product"),
    ]


def case_details(cases: DataFrame) -> DataFrame:
    return cases.select(*case_fields(cases))


def _tie(cases: DataFrame) -> list[Column]:
    return [col("case number")] if "case number" in cases.columns else []


def recent_cases(cases: DataFrame, limit: int = RECENT_CASES) -> DataFrame:
    """The newest cases opened at least a day before `ref`; where there are none, all cases by date."""
    opened = col("date open")
    order = [opened.desc_nulls_last(), *_tie(cases)]
    is_older = opened <= F.col("ref") - F.expr("INTERVAL 1 DAY")
    older, has_older = cases.where(is_older), cases.agg(F.max(is_older)).first()[0]
    if has_older is None:  # no case has an opening date
        chosen = cases.limit(0)
    else:
        chosen = older.orderBy(*order).limit(limit) if has_older else cases.orderBy(*order)
    return chosen.select(
        *case_fields(cases), F.coalesce(opened.cast("date").cast("string"), F.lit("N/A")).alias("last_updated")
    )


def attention_cases(cases: DataFrame, limit: int | None = None) -> DataFrame:
    """Open cases with a target, most urgent first, each with the days until (or since) its target."""
    target = col("solution target")
    days = F.rint(hours_between(F.col("ref"), target) / 24.0).cast("int")
    issue = (
        F.when(days < 0, F.concat(F.lit("Overdue by "), F.abs(days).cast("string"), F.lit("d")))
        .when(days == 0, "SLA Target due today")
        .otherwise(F.concat(F.lit("SLA Target in "), days.cast("string"), F.lit("d")))
    )
    urgent = cases.where(~_closed() & target.isNotNull()).orderBy(target, *_tie(cases))
    urgent = urgent if limit is None else urgent.limit(limit)
    return urgent.select(*case_fields(cases), issue.alias("issue"))


def filter_cases(
    details: DataFrame, search: str | None = None, start: date | str | None = None, end: date | str | None = None,
    severities: Iterable[str] = (), regions: Iterable[str] = (), teams: Iterable[str] = (),
) -> DataFrame:
    """Case details by text, opening day (both ends included), severity, region and team (else owner).

    Severity Critical also finds High cases, as the buckets hold both under High.
    """
    def has(name: str) -> bool:
        return name in details.columns

    keep: list[Column] = []
    if search and search.strip():
        term = search.lower().strip()
        keep.append(reduce(or_, [F.lower(col(c)).contains(term) for c in SEARCH_FIELDS if has(c)]))
    opened = F.col("date_open").try_cast("timestamp_ntz") if has("date_open") else F.lit(None).cast("timestamp_ntz")
    if start:
        keep.append(opened.isNull() | (opened >= F.lit(str(start)).cast("timestamp_ntz")))
    if end:
        after = F.lit(str(_day(end) + timedelta(days=1))).cast("timestamp_ntz")
        keep.append(opened.isNull() | (opened < after))
    wanted = {"High" if s == "Critical" else s for s in severities}
    if wanted:
        keep.append(F.col("priority").isin(*sorted(wanted)))
    if regions := list(regions):
        keep.append(F.col("region").isin(*regions) if has("region") else F.lit(False))
    if teams := list(teams):
        team = F.coalesce(F.col("team"), F.col("case_owner")) if has("team") else F.col("case_owner")
        keep.append(team.isin(*teams))
    return details.where(reduce(lambda a, b: a & b, keep)) if keep else details


def _day(value: date | str) -> date:
    return date.fromisoformat(value) if isinstance(value, str) else value


def dashboard(df: DataFrame, as_of: datetime | None = None, day_first: bool = False) -> dict[str, DataFrame]:
    """All dashboard blocks.  The counted ones share one small rollup, written as a copy that release_copies removes.

    `day_first` reads dd/mm dates.
    """
    cases = bucketed_cases(df, as_of, day_first)
    rollup = cut_lineage(daily_rollup(cases))
    return {
        "summary": sla_summary(rollup),
        "distribution": case_distribution(rollup),
        "weekdays": weekday_volume(rollup),
        "volume": monthly_volume(rollup),
        "recent": recent_cases(cases),
        "attention": attention_cases(cases),
    }
