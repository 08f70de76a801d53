"""Places of rows within groups and running values along them, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.session import cut_lineage

#: Places whose running values are found in one place before whole blocks are added.
BLOCK = 256


def with_places(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rows` with `place`, from 0 on in the order of `order` within each group of `keys`; nulls come first, equal rows in any order.

    Rows are range-partitioned by keys and order, with a row number at the end, and written; a group that holds most
    rows, or one row repeated, spreads over many tasks.  A place is the position in the partition plus the group's rows
    in earlier partitions.
    """
    sort = [*keys, *order, "_number"]
    dealt = rows.withColumn("_number", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_number")
    written = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = written.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    parts = parts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_own"), shift.alias("_shift"))
    same = written["_part"] == parts["_own"]
    for i, k in enumerate(keys):
        same = same & written[k].eqNullSafe(parts[f"_key{i}"])
    return written.join(parts, same).withColumn("place", F.col("_at") + F.col("_shift")).select(*rows.columns, "place")


def running(rows: DataFrame, keys: Sequence[str], **values: tuple[str, Column]) -> DataFrame:
    """`rows` (with `place`) with running values added: name=("sum" or "bit_xor", value), up to and with the own row.

    They run within blocks of BLOCK places and over the blocks' totals.  Keys are not null.
    """
    kinds = {"sum": (F.sum, lambda a, b: a + b), "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}
    marked = rows.withColumn("_block", F.floor(F.col("place") / BLOCK))
    within = Window.partitionBy(*keys, "_block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*keys, "_block").agg(*[kinds[kind][0](value).alias(f"_{name}") for name, (kind, value) in values.items()])
    totals = totals.select(*keys, "_block", *[F.coalesce(kinds[kind][0](f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name, (kind, _) in values.items()])
    summed = marked.select("*", *[kinds[kind][0](value).over(within).alias(f"_own_{name}") for name, (kind, value) in values.items()])
    joined = summed.join(totals, [*keys, "_block"])
    return joined.select(*rows.columns, *[kinds[kind][1](F.col(f"_{name}"), F.col(f"_own_{name}")).alias(name) for name, (kind, _) in values.items()])
