"""Equi-joins of tables in which a few keys, or missing keys, hold much of the rows.

Frequent keys are found by a mergeable frequent-items sketch over hashes of the key.  The rows of a frequent key are
dealt to a grid: a row of the left side goes to one line of cells and a row of the right side to one column, so each pair
meets in exactly one cell and no task holds more than a cell's share of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import col

#: Hashes that a sketch may hold; it finds every key with more than 1 / (0.75 * TRACKED) of the rows.
TRACKED = 4096


def frequent_hashes(keys: DataFrame, key: Column, least: int) -> dict[int, int]:
    """Hash of a key -> estimated rows, for keys with at least about `least` rows; a null key counts as a key.

    At most TRACKED entries come back.  An estimate is never less than the true count.
    """
    found = keys.select(F.xxhash64(key).alias("h")).agg(F.expr(f"approx_top_k(h, {TRACKED // 2}, {TRACKED})").alias("top")).first()[0]
    return {r["item"]: r["count"] for r in found or [] if r["item"] is not None and r["count"] >= least}


def join_size(left: DataFrame, right: DataFrame, key: str, null_safe: bool = True) -> DataFrame:
    """One row `pairs, null_pairs`: the rows that an inner join on `key` gives, from counts of keys alone.

    Counts are combined before the shuffle, so no key is hot.  Both are decimals, as products of counts leave 64 bits.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(col(key).alias("k")).agg(F.count("*").cast("decimal(19,0)").alias(name))

    a, b = counted(left, "a"), counted(right, "b").withColumnRenamed("k", "k2")
    same = F.col("k").eqNullSafe(F.col("k2")) if null_safe else F.col("k") == F.col("k2")
    pairs = (F.col("a") * F.col("b")).cast("decimal(38,0)")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,0)")

    return a.join(b, same).agg(total(pairs).alias("pairs"), total(F.when(F.col("k").isNull(), pairs)).alias("null_pairs"))


def split_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot_rows: int) -> DataFrame:
    """Inner join on equal keys, nulls equal; keys with more than `hot_rows` rows on a side are split into cells.

    A cell holds about `hot_rows` rows a side at most.  Rows are dealt by their place in the scan, so repeated rows
    spread as well; the inputs should be files or written copies, whose order a lost executor does not change.
    The result holds the columns of both sides.
    """
    lefts, rights = (frequent_hashes(df, col(key), hot_rows) for df, key in ((left, left_key), (right, right_key)))
    grid = {}
    for h in lefts.keys() | rights.keys():
        lines, columns = max(1, -(-lefts.get(h, 0) // hot_rows)), max(1, -(-rights.get(h, 0) // hot_rows))
        if lines * columns > 1:
            grid[h] = (lines, columns)
    if not grid:
        return left.join(right, left[f"`{left_key}`"].eqNullSafe(right[f"`{right_key}`"]), "inner")
    # At most TRACKED entries a side, so the table of cells may be broadcast.
    spark = left.sparkSession
    cells = spark.createDataFrame([(h, a, b) for h, (a, b) in grid.items()], "__hot bigint, __lines bigint, __columns bigint")

    def dealt(df: DataFrame, key: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        """Rows of hot keys with their own line and a copy for each column, all others in cell (0, 0)."""
        rows = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__hash", F.xxhash64(col(key)))
        rows = rows.join(F.broadcast(cells), F.col("__hash") == F.col("__hot"), "left")
        mine = F.coalesce(F.pmod(F.col("__at"), F.col(own)), F.lit(0))
        theirs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other), F.lit(1)) - 1))
        return rows.select(*[col(c) for c in df.columns], mine.alias(names[0]), theirs.alias(names[1]))

    a = dealt(left, left_key, "__lines", "__columns", ("__al", "__ac"))
    b = dealt(right, right_key, "__columns", "__lines", ("__bc", "__bl"))
    met = a.join(
        b, a[f"`{left_key}`"].eqNullSafe(b[f"`{right_key}`"]) & (a["__al"] == b["__bl"]) & (a["__ac"] == b["__bc"]), "inner")
    return met.drop("__al", "__ac", "__bl", "__bc")
