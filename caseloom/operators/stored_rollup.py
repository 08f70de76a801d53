"""A stored dashboard rollup: appended cases are counted once, for any reference date.

Whether a case is overdue, and which week it was opened in, depends on the reference date.  So the store holds counts by
opening time and, apart from them, counts of unclosed cases by target time, each by day and by exact time.  A rollup for
a reference date is a sum of whole days up to it; exact times are read only for the three days that its limits cut.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.columns import col
from caseloom.functions.values import hours_between
from caseloom.operators.dashboard import bucketed_cases

STORED = """fact string, day date, at timestamp_ntz, status_bucket string, priority_bucket string, n bigint, hours double,
  timed bigint, batch string, grain string"""
BUCKETS = ("status_bucket", "priority_bucket")
WEEK = timedelta(days=7)


def append_cases(df: DataFrame, path: str, batch: str, day_first: bool = False) -> None:
    """Count the cases of a batch into the store at `path`; only this batch is read.

    A batch that is appended again, after a failure or with corrected cases, replaces what it gave before.  Cases
    without an opening time are kept under a null day.  `batch` holds letters, digits, `_`, `.` and `-`.
    """
    if not re.fullmatch(r"[\w.-]+", batch, re.ASCII):
        raise ValueError(f"no name of a batch: {batch!r}")
    cases = bucketed_cases(df, day_first=day_first)
    opened, target = col("date open"), col("solution target")
    unclosed = F.col("status_bucket") != "Closed"
    facts = cases.select(*BUCKETS, F.inline(F.array(
        F.struct(F.lit("opened").alias("fact"), opened.alias("at"), hours_between(opened, target).cast("double").alias("hours")),
        F.struct(F.lit("target").alias("fact"), F.when(unclosed, target).alias("at"), F.lit(None).cast("double").alias("hours")),
    ))).where((F.col("fact") == "opened") | F.col("at").isNotNull())
    exact = facts.groupBy("fact", F.col("at").cast("date").alias("day"), "at", *BUCKETS).agg(
        F.count("*").alias("n"), F.sum("hours").alias("hours"), F.count("hours").alias("timed"))
    by_day = exact.groupBy("fact", "day", *BUCKETS).agg(
        F.max("at").alias("at"), F.sum("n").alias("n"), F.sum("hours").alias("hours"), F.sum("timed").alias("timed"))
    both = exact.withColumn("grain", F.lit("time")).unionByName(by_day.withColumn("grain", F.lit("day")))
    both.sortWithinPartitions("day").write.partitionBy("grain").mode("overwrite").parquet(f"{path}/batch={batch}")


def rollup_at(spark: SparkSession, path: str, as_of: datetime | None = None) -> DataFrame:
    """The daily rollup of all stored cases, seen from `as_of`, else from the latest opening time, else from now.

    It has the columns of dashboard.daily_rollup and serves the same figures; overdue cases stand in rows of their own,
    with a null day, as the store does not tie a target to an opening day.
    """
    stored = spark.read.schema(STORED).parquet(path)
    days, times = stored.where(F.col("grain") == "day"), stored.where(F.col("grain") == "time")
    if as_of is None:
        as_of = days.where(F.col("fact") == "opened").agg(F.max("at")).first()[0] or datetime.now()
    this, last = as_of - WEEK, as_of - 2 * WEEK

    def since(limit: datetime):
        """Whole days after the limit's day, or exact times from the limit on."""
        return F.when(F.col("grain") == "day", F.col("day") > F.lit(limit.date())).otherwise(F.col("at") >= F.lit(limit))

    def parts(fact: str, limits: list[datetime]) -> DataFrame:
        cut = F.col("day").isin(*{limit.date() for limit in limits})
        whole = days.where((F.col("fact") == fact) & (F.col("day").isNull() | ~cut))
        return whole.unionByName(times.where((F.col("fact") == fact) & cut))

    week = F.when(since(this), "this").when(since(last), "last")
    nothing = F.lit(0).cast("bigint")
    opened = parts("opened", [this, last]).select("day", week.alias("week"), *BUCKETS, "n", nothing.alias("overdue"), "hours", "timed")
    past = F.when(F.col("grain") == "day", F.col("day") < F.lit(as_of.date())).otherwise(F.col("at") < F.lit(as_of))
    overdue = parts("target", [as_of]).where(past).select(
        F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("week"), *BUCKETS, nothing.alias("n"),
        F.col("n").alias("overdue"), F.lit(None).cast("double").alias("hours"), nothing.alias("timed"))
    return opened.unionByName(overdue).groupBy("day", "week", *BUCKETS).agg(
        *[F.sum(c).alias(c) for c in ("n", "overdue", "hours", "timed")])
