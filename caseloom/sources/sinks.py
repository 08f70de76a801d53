"""Writing combined tables, column statistics and the run log."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import PurePosixPath
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

RUN_SCHEMA = (
    "run_id string, dataset string, target string, model string, metric string, score double, "
    "status string, date timestamp"
)


def combined_name(left: str, right: str, mode: str) -> str:
    """`{left}_{right}_joined.csv` or `..._combined.csv`."""
    suffix = "joined" if mode == "join" else "combined"
    return f"{PurePosixPath(left).stem}_{PurePosixPath(right).stem}_{suffix}.csv"


def write_csv(df: DataFrame, path: str) -> str:
    """A folder of delimited text files with headers, written in parallel."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_stats_json(stats: DataFrame, path: str) -> str:
    stats.write.mode("overwrite").json(path)
    return path


def log_run(
    spark: SparkSession, path: str, dataset: str, target: str, model: str, metric: str | None = None,
    score: float | None = None, status: str = "Completed",
) -> str:
    """Append one run; returns its id."""
    run_id = f"RUN-{uuid4().hex[:12]}"
    row = (run_id, dataset, target, model, metric, score, status, datetime.now(timezone.utc))
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return run_id


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """Logged runs, newest first."""
    return spark.read.schema(RUN_SCHEMA).parquet(path).orderBy(F.desc("date"), F.desc("run_id"))


def clear_history(spark: SparkSession, path: str) -> None:
    """Replace the log by an empty one."""
    spark.createDataFrame([], RUN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
