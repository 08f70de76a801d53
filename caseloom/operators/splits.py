"""Deterministic splits and folds: shares are exact, and the rows themselves are not shuffled.

Each row gets a 64-bit hash of its key and a seed.  Without a key equal rows are numbered first, so that each has
a hash of its own and shares stay exact.  A split is a cut in hash order.  The cut of a
class is found by counting rows per hash range and ranking only the range that holds it, so a class
with most of the rows is still spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.columns import col
from caseloom.session import cut_lineage

RANGE_ROWS = 100_000
SMALL_TABLE_ROWS = 10_000


def content_hash(df: DataFrame, seed: int = 42, key: str | None = None) -> Column:
    names = [key] if key else sorted(df.columns)
    return F.xxhash64(F.lit(seed), *[col(n) for n in names])


def hash_cuts(hashed: DataFrame, label: str, shares: Sequence[float]) -> DataFrame:
    """`label, cuts`: per label the hash below or at which the first round(share * n) rows lie.

    `hashed` has the columns `label` and `hash`.
    """
    rows = hashed.count()
    bits = min(20, max(0, math.ceil(math.log2(max(1, rows / RANGE_ROWS)))))
    spread = F.shiftright(F.col("hash"), 64 - bits) if bits else F.lit(0).cast("bigint")
    ranged = hashed.select(label, "hash", spread.alias("range"))
    by_range = Window.partitionBy(label).orderBy("range")
    counts = ranged.groupBy(label, "range").agg(F.count("*").alias("n")).select(
        label, "range",
        F.sum("n").over(by_range).alias("upto"),
        (F.sum("n").over(by_range) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy(label)).alias("total"),
    )
    goals = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.round(F.col("total") * share).cast("bigint").alias("goal"))
        for i, share in enumerate(shares)
    ])
    targets = (
        counts.select(label, "range", "before", "upto", F.explode(goals).alias("t"))
        .where((F.col("t.goal") > F.col("before")) & (F.col("t.goal") <= F.col("upto")))
        .select(label, "range", "t.pos", (F.col("t.goal") - F.col("before")).alias("nth"))
    )
    targets = local_if_small(targets)
    ranked = ranged.join(targets.select(label, "range").distinct(), [label, "range"], "left_semi").withColumn(
        "nth", F.row_number().over(Window.partitionBy(label, "range").orderBy("hash")).cast("bigint")
    )
    return (
        ranked.join(targets, [label, "range", "nth"])
        .groupBy(label).agg(F.array_sort(F.collect_list("hash")).alias("cuts"))
    )


def local_if_small(table: DataFrame, rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """The table as a broadcast of checked size, or unchanged where it has more rows."""
    found = table.limit(rows + 1).collect()
    return F.broadcast(table.sparkSession.createDataFrame(found, table.schema)) if len(found) <= rows else table


def numbered_copies(df: DataFrame, seed: int = 42) -> DataFrame:
    """Adds `_row`, a hash that differs between equal rows: of the content and the row's number among its equals.

    The rows are written once, so that all later passes see the same ones.  Where no row repeats, which a count of
    hashes tells, no row is shuffled.  Otherwise equal rows are numbered within the partitions they lie in and offset by
    the counts of earlier partitions, so many copies of one row are spread over tasks.  The set of hashes does not
    depend on the partitions.  A key saves all this.
    """
    copy = cut_lineage(df.withColumn("_content", content_hash(df, seed)).withColumn("_part", F.spark_partition_id()))
    if not _repeats(copy, df.columns, seed):
        return copy.withColumn("_row", F.xxhash64("_content", F.lit(1).cast("bigint"))).drop("_content", "_part")
    earlier = Window.partitionBy("_content").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = copy.groupBy("_content", "_part").agg(F.count("*").alias("_n")).select(
        "_content", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_content", "_part").orderBy(F.lit(0)))
    rows = copy.withColumn("_local", local).join(offsets, ["_content", "_part"])
    numbered = rows.withColumn("_row", F.xxhash64("_content", F.col("_before") + F.col("_local")))
    # Written too: the passes that find the cuts would number the rows anew.
    return cut_lineage(numbered.drop("_content", "_part", "_local", "_before"))


def _repeats(copy: DataFrame, columns: Sequence[str], seed: int) -> bool:
    """Whether a row occurs twice, by two hashes of its content, so that chance matches stay unlikely at any size."""
    other = content_hash(copy.select(*[col(c) for c in columns]), seed + 1)
    return not copy.groupBy("_content", other.alias("_other")).count().where("count > 1").isEmpty()


def _with_cuts(df: DataFrame, label: str | None, shares: Sequence[float], seed: int, key: str | None) -> DataFrame:
    """Adds `_hash` and `_cuts` to every row."""
    if key is None:
        df, key = numbered_copies(df, seed), "_row"
    # A missing label is a class like any other.
    group = F.lit("") if label is None else F.coalesce(F.concat(F.lit("="), col(label).cast("string")), F.lit(""))
    hashed = df.withColumn("_hash", content_hash(df, seed, key)).withColumn("_group", group)
    cuts = hash_cuts(
        hashed.select(F.col("_group"), F.col("_hash").alias("hash")), "_group", shares
    ).withColumnRenamed("cuts", "_cuts")
    return hashed.join(local_if_small(cuts), "_group", "left").drop("_group", "_row")


def _position(df: DataFrame) -> Column:
    """How many cuts lie before the row's hash."""
    return F.size(F.filter(F.coalesce(F.col("_cuts"), F.array().cast("array<bigint>")), lambda c: c < F.col("_hash")))


def check_test_size(test_size: float) -> None:
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must be between 0.1 and 0.5")


def assign_test(
    df: DataFrame, test_size: float = 0.2, stratify: str | None = None, seed: int = 42, key: str | None = None,
    out: str = "is_test",
) -> DataFrame:
    """Adds a boolean column: true for `test_size` of the rows (of each class of `stratify`)."""
    check_test_size(test_size)
    marked = _with_cuts(df, stratify, [test_size], seed, key)
    taken = (F.size(F.coalesce(F.col("_cuts"), F.array().cast("array<bigint>"))) > 0) & (_position(marked) == 0)
    return marked.withColumn(out, taken).drop("_hash", "_cuts")


def train_test(
    df: DataFrame, test_size: float = 0.2, stratify: str | None = None, seed: int = 42, key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    marked = assign_test(df, test_size, stratify, seed, key, out="_is_test")
    return (
        marked.where(~F.col("_is_test")).drop("_is_test"),
        marked.where("_is_test").drop("_is_test"),
    )


def assign_folds(
    df: DataFrame, folds: int = 5, stratify: str | None = None, seed: int = 42, key: str | None = None,
    out: str = "fold",
) -> DataFrame:
    """Adds fold ids 0..folds-1 of equal size (per class of `stratify`)."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    marked = _with_cuts(df, stratify, [i / folds for i in range(1, folds)], seed, key)
    return marked.withColumn(out, _position(marked).cast("int")).drop("_hash", "_cuts")
