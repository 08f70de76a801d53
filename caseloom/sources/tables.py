"""Reading tables: delimited text with inferred types, Parquet, JSON and ORC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from caseloom.functions.columns import col
from caseloom.functions.values import NA_TOKENS, NUMBER_PATTERN
from caseloom.sources.records import read_records

FORMATS = ("csv", "parquet", "json", "orc")
# Texts that are read as booleans.
TRUE_TEXTS, FALSE_TEXTS = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def format_of(path: str) -> str:
    name = path.rstrip("/").lower()
    for fmt in FORMATS:
        if name.endswith(f".{fmt}") or name.endswith(f".{fmt}.gz"):
            return fmt
    raise ValueError(f"cannot tell the format of {path!r}; name one of {FORMATS}")


def load_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
    multiline: bool = True,
) -> DataFrame:
    """A table by path.  For text files give a schema at scale: inferring types reads the data once more.

    Quoted fields of a CSV file may hold line breaks; a file is read by many tasks all the same (see read_records).
    `multiline=False` is for files without them: it only checks that no line leaves a quote open.
    """
    fmt = fmt or format_of(path)
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; choose from {FORMATS}")
    if fmt == "csv":
        df = read_csv(spark, path, schema, multiline)
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.format(fmt).load(path)
    if not df.columns:
        raise ValueError(f"{path!r} has no columns")
    return df


def spread_rows(table: DataFrame) -> DataFrame:
    """A table without shuffles in its plan over all cores, for work that is heavy per row.

    A file with few row groups gives few tasks.  A table with enough splits is returned unchanged, so
    large data is not shuffled for this.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True
) -> DataFrame:
    """Delimited text with a header; the usual missing-value texts are NULL and types are inferred."""
    if not multiline:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        broken = spark.read.text(path).agg(F.count_if(quotes % 2 == 1)).first()[0]
        if broken:
            raise ValueError(f"{path!r} has line breaks in quoted fields ({broken} lines); read it with multiline=True")
    raw = read_records(spark, path) if multiline else spark.read.csv(path, header=True, inferSchema=False, escape='"')
    texts = raw.select(*[F.when(~col(c).isin(*NA_TOKENS), col(c)).alias(c) for c in raw.columns])
    if schema is None:
        return typed(texts)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return texts.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def typed(texts: DataFrame) -> DataFrame:
    """String columns as bigint, double or boolean where every value is one; one aggregate decides."""
    if not texts.columns:
        return texts
    counts = texts.agg(*[
        e.alias(f"{k}{i}")
        for i, c in enumerate(texts.columns)
        for k, e in (
            ("n", F.count(col(c))),
            ("whole", F.count(F.when(col(c).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(col(c)).try_cast("bigint")))),
            ("real", F.count_if(col(c).rlike(NUMBER_PATTERN))),
            ("bool", F.count_if(col(c).isin(*TRUE_TEXTS, *FALSE_TEXTS))),
        )
    ]).first()

    def converted(i: int, c: str):
        n = counts[f"n{i}"]
        if n == 0:
            return col(c)
        if counts[f"whole{i}"] == n:
            return F.trim(col(c)).cast("bigint").alias(c)
        if counts[f"real{i}"] == n:
            return F.trim(col(c)).cast("double").alias(c)
        if counts[f"bool{i}"] == n:
            return col(c).isin(*TRUE_TEXTS).alias(c)
        return col(c)

    return texts.select(*[converted(i, c) for i, c in enumerate(texts.columns)])
