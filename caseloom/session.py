"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "caseloom", **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`.

    Only a local session may go without: it uses the context's folder or a new temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))
    return context.getCheckpointDir()


_COPIES: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder.

    Lost executors then cost no recomputation, and later passes read only the columns they need.  release_copies
    removes the tables once no result of theirs is needed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    _COPIES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_copies(spark: SparkSession) -> int:
    """Remove all tables that cut_lineage wrote in this process; returns how many."""
    removed = 0
    while _COPIES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_COPIES.pop())
        removed += path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return removed
