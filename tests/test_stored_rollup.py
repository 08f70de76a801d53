"""A rollup stored in parts against one pass over all cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseloom.operators.dashboard import bucketed_cases, case_distribution, daily_rollup, monthly_volume, sla_summary, weekday_volume
from caseloom.operators.stored_rollup import append_cases, rollup_at

LATEST = datetime(2024, 3, 20, 15, 30, 10)


@pytest.fixture(scope="module")
def cases(spark):
    rows = []
    for i in range(400):
        opened = LATEST - timedelta(hours=7 * i, seconds=13 * i) if i % 17 else None
        target = LATEST + timedelta(hours=5 * (i % 90) - 200, seconds=i) if i % 5 else None
        rows.append((i, opened, target, ("Closed", "open", "pending", None)[i % 4], ("High", "low", None)[i % 3], "clash"))
    # Limits of weeks and of the reference date, met exactly.
    rows += [(1000 + i, at, at, "open", "high", "x") for i, at in enumerate([LATEST, LATEST - timedelta(days=7), LATEST - timedelta(days=14)])]
    return spark.createDataFrame(rows, "`Case Number` long, `Date Open` timestamp_ntz, `Solution Target` timestamp_ntz, Status string, Priority string, at string")


def figures(rollup):
    return [[tuple(r) for r in block(rollup).collect()] for block in (sla_summary, case_distribution, weekday_volume, monthly_volume)]


def test_three_parts_equal_one_pass(spark, cases, tmp_path):
    path = str(tmp_path / "store")
    for part in range(3):
        append_cases(cases.where(F.col("Case Number") % 3 == part), path, f"part-{part}")
    expected = figures(daily_rollup(bucketed_cases(cases)))
    assert figures(rollup_at(spark, path)) == expected
    append_cases(cases.where(F.col("Case Number") % 3 == 1), path, "part-1")  # again: it replaces itself
    assert figures(rollup_at(spark, path)) == expected
    append_cases(cases.limit(0), path, "part-1")
    assert figures(rollup_at(spark, path)) == figures(daily_rollup(bucketed_cases(cases.where(F.col("Case Number") % 3 != 1))))


@pytest.mark.parametrize("as_of", [LATEST - timedelta(days=7), datetime(2024, 3, 18), LATEST + timedelta(days=3, microseconds=1), datetime(1999, 1, 1)])
def test_any_reference_date(spark, cases, tmp_path, as_of):
    path = str(tmp_path / "store")
    append_cases(cases, path, "all")
    seen = bucketed_cases(cases).withColumn("ref", F.lit(as_of).cast("timestamp_ntz"))
    assert figures(rollup_at(spark, path, as_of)) == figures(daily_rollup(seen))


def test_exact_times_are_read_for_the_cut_days_only(spark, cases, tmp_path):
    path = str(tmp_path / "store")
    append_cases(cases, path, "all")
    plan = rollup_at(spark, path, LATEST)._jdf.queryExecution().toString()
    assert "In(day" in plan and "grain" in plan


def test_nothing_stored_and_no_dates(spark, cases, tmp_path):
    empty = str(tmp_path / "empty")
    append_cases(cases.limit(0), empty, "none")
    assert sla_summary(rollup_at(spark, empty)).first().open_cases == 0
    undated = str(tmp_path / "undated")
    append_cases(cases.select("Status"), undated, "a")
    assert sla_summary(rollup_at(spark, undated)).first().open_cases == cases.where("coalesce(Status, '') <> 'Closed'").count()
    with pytest.raises(ValueError):
        append_cases(cases, empty, "a/b")
