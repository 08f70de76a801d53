"""One-hot flags, label codes, column alignment and class balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, Window, functions as F

from caseloom.functions.columns import col, text_columns
from caseloom.operators.profile import value_counts
from caseloom.session import cut_lineage

SEVERE_PCT = 10
MILD_PCT = 30
#: Labels of a target that may come to the driver unasked.
LOCAL_LABELS = 10_000


def categories(
    df: DataFrame, columns: Sequence[str], max_categories: int | None = None
) -> dict[str, list[str]]:
    """The sorted values of each text column: the dictionary of its flags.

    With `max_categories` a column of more values is an error before any value reaches the driver.
    """
    if not columns:
        return {}
    counts = value_counts(df, columns)
    if max_categories is not None:
        sizes = counts.groupBy("column").agg(F.count("*").alias("n")).collect()
        wide = {r["column"]: r["n"] for r in sizes if r["n"] > max_categories}
        if wide:
            raise ValueError(f"too many categories for one-hot flags (limit {max_categories}): {wide}")
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in counts.select("column", "value").orderBy("column", "value").collect():
        found[r["column"]].append(r["value"])
    return found


def one_hot(
    df: DataFrame, target: str | None = None, values: Mapping[str, Sequence[str]] | None = None,
    max_categories: int | None = None,
) -> DataFrame:
    """Text features replaced by boolean `{column}_{value}` flags; null sets none of them.

    This is the wide form; one_hot_index is the form for columns of very many values.
    """
    texts = text_columns(df, but=[target] if target else [])
    values = values if values is not None else categories(df, texts, max_categories)
    kept = [col(c) for c in df.columns if c not in values]
    flags = [
        F.coalesce(col(c) == v, F.lit(False)).alias(f"{c}_{v}") for c, vs in values.items() for v in vs
    ]
    return df.select(*kept, *flags)


def indexed(df: DataFrame, column: str, values: Sequence[str], out: str) -> DataFrame:
    """Adds the place of the row's value in `values` (int); null where it is not among them.  A hash look-up in the JVM."""
    text = df.withColumn("__text", col(column).cast("string"))
    if not values:
        return df.withColumn(out, F.lit(None).cast("int"))
    model = StringIndexerModel.from_labels(list(values), inputCol="__text", outputCol="__at", handleInvalid="keep")
    found = model.transform(text)
    return found.withColumn(out, F.when(F.col("__at") < len(values), F.col("__at").cast("int"))).drop("__text", "__at")


def one_hot_index(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(`df` with `{column}_index`, `value, index`): one-hot flags in sparse form for any number of values.

    The dictionary is a table and is joined back; where it is small Spark broadcasts it, else a frequent value is split.
    """
    name = f"{column}_index"
    values = df.where(col(column).isNotNull()).select(col(column).cast("string").alias("value")).distinct()
    ordered = values.orderBy("value").withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    ordered = cut_lineage(ordered)
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    offsets = sizes.select("__part", "first", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("offset"))
    table = ordered.join(F.broadcast(offsets), "__part").select("value", (F.col("offset") + F.col("__at") - F.col("first")).alias("index"))
    joined = df.join(table.withColumnsRenamed({"value": "__value", "index": name}), col(column).cast("string") == F.col("__value"), "left")
    return joined.drop("__value"), table


def product_flags(df: DataFrame, column: str = "product", prefix: str = "prod_") -> DataFrame:
    """Adds 0/1 `prod_{value}` columns and keeps the source column."""
    values = categories(df, [column])[column]
    return df.select(
        "*", *[F.coalesce((col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values]
    )


def label_list(df: DataFrame, target: str, limit: int | None = None) -> list[str]:
    """The distinct values as sorted texts; with `limit` more values are an error, not a cut list."""
    labels = df.where(col(target).isNotNull()).select(col(target).cast("string").alias("label")).distinct()
    found = [r["label"] for r in (labels if limit is None else labels.limit(limit + 1)).collect()]
    if limit is not None and len(found) > limit:
        raise ValueError(f"{target!r} has more than {limit} distinct values, too many for a class target")
    return sorted(found)


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """`label, code`: the distinct values in sorted order from 0."""
    found = label_list(df, target)
    return df.sparkSession.createDataFrame(list(zip(found, range(len(found)))), "label string, code int")


def encode_target(
    df: DataFrame, target: str, labels: Sequence[str] | None = None, small: int = LOCAL_LABELS
) -> tuple[DataFrame, list[str] | DataFrame]:
    """Text target replaced by its code (double); returns the labels in code order.

    With more than `small` labels none reaches the driver: the codes are joined, and the labels are a table `value, index`.
    """
    if labels is None:
        distinct = df.where(col(target).isNotNull()).select(col(target).cast("string").alias("label")).distinct()
        found = [r["label"] for r in distinct.limit(small + 1).collect()]
        if len(found) > small:
            joined, table = one_hot_index(df.withColumn("__label", col(target)), "__label")
            code = F.col("__label_index").cast("double")
            return joined.select(*[code.alias(c) if c == target else col(c) for c in df.columns]), table
        labels = sorted(found)
    coded = indexed(df, target, labels, "__code")
    code = F.col("__code").cast("double")
    return coded.select(*[code.alias(c) if c == target else col(c) for c in df.columns]), list(labels)


def map_labels(df: DataFrame, column: str, mapping: Mapping[str, int]) -> DataFrame:
    """Replace the values of a column by a fixed map; an unknown value becomes NULL."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(column, F.get(F.map_values(F.map_filter(table, lambda k, _: k == col(column))), F.lit(0)))


def align_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exactly the listed columns in that order; a missing one is 0, an extra one is dropped."""
    return df.select(*[col(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """`label, n, pct, verdict`: verdict severe / mild / balanced by the smallest class."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("total"), F.min("n").alias("least")).alias("t")).scalar()
    share = F.col("t.least") * 100.0 / F.col("t.total")
    verdict = F.when(share < SEVERE_PCT, "severe").when(share < MILD_PCT, "mild").otherwise("balanced")
    return counts.select("*", totals.alias("t")).select(
        "label", "n", (F.col("n") * 100.0 / F.col("t.total")).alias("pct"), verdict.alias("verdict")
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """`label, weight` with weight = rows / (classes * rows of the class)."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes")).alias("t")).scalar()
    return counts.select("*", totals.alias("t")).select(
        "label", (F.col("t.rows") / (F.col("t.classes") * F.col("n"))).alias("weight")
    )


def with_class_weights(df: DataFrame, target: str, out: str = "weight", small: int = 10_000) -> DataFrame:
    """Adds the balanced weight of each row's class; the weight table is broadcast only when small."""
    weights = class_weights(df, target).withColumnRenamed("label", "__label").withColumnRenamed("weight", out)
    local = weights.limit(small + 1).collect()
    table = weights
    if len(local) <= small:
        table = F.broadcast(df.sparkSession.createDataFrame(local, weights.schema))
    return df.join(table, col(target) == F.col("__label"), "left").drop("__label")
