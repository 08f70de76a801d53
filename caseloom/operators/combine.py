"""Stacking and joining two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from caseloom.functions.columns import col, is_numeric
from caseloom.operators.hot_keys import join_size, split_join

# Name parts that mark a likely key column.
KEY_HINTS = ("id", "number", "key", "code", "no")


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def _common_type(a: T.DataType, b: T.DataType) -> str | None:
    """Type to cast both sides to, or None where they are equal."""
    if a == b:
        return None
    if is_numeric(a) and is_numeric(b):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return "bigint" if isinstance(a, whole) and isinstance(b, whole) else "double"
    times = (T.DateType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return "timestamp_ntz"
    return "string"


def _aligned(left: DataFrame, right: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    casts = {c: _common_type(left.schema[c].dataType, right.schema[c].dataType) for c in names}

    def cast(df: DataFrame) -> DataFrame:
        return df.select(*[col(c).cast(casts[c]).alias(c) if casts.get(c) else col(c) for c in df.columns])

    return (cast(left), cast(right)) if any(casts.values()) else (left, right)


def stack_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both tables by column name; a column one side lacks is NULL there."""
    shared = shared_columns(left, right)
    if not shared:
        raise ValueError("the tables share no column name, so they cannot be stacked")
    a, b = _aligned(left, right, shared)
    return a.unionByName(b, allowMissingColumns=True)


def pick_join_column(left: DataFrame, right: DataFrame) -> str:
    """The shared column, key-like ones first, with most distinct values in `left`."""
    shared = shared_columns(left, right)
    if not shared:
        raise ValueError("the tables share no column name, so there is nothing to join on")
    candidates = [c for c in shared if any(h in c.lower() for h in KEY_HINTS)] or shared
    if len(candidates) == 1:
        return candidates[0]
    # One pass per candidate reads one column; several distinct counts in one pass would repeat every row for each.
    counts = [left.select(col(c)).where(col(c).isNotNull()).distinct().count() for c in candidates]
    return candidates[max(range(len(candidates)), key=lambda i: (counts[i], -i))]


def join_tables(
    left: DataFrame, right: DataFrame, on: str | None = None, require_match: bool = False, hot_rows: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Inner join on one shared column; null keys match each other, other shared columns get _a/_b.

    No side is broadcast by hint: sizes decide at run time, and a skewed key is split by AQE.  With `hot_rows`, keys of
    more rows than that on a side (the missing key too) are found first and their pairs dealt to many tasks.  With
    `max_rows`, a join of more rows is an error, raised from counts of keys before any row is joined.
    """
    shared = shared_columns(left, right)
    key = on if on in shared else pick_join_column(left, right)
    a, b = _aligned(left, right, [key])
    if max_rows is not None:
        size = join_size(a, b, key).first()
        if size.pairs > max_rows:
            raise ValueError(f"the join on {key!r} gives {size.pairs} rows, {size.null_pairs} of them by missing keys")
    overlap = set(shared) - {key}
    a = a.toDF(*[f"{c}_a" if c in overlap else c for c in a.columns])
    b = b.toDF(*["__key" if c == key else f"{c}_b" if c in overlap else c for c in b.columns])
    if hot_rows is None:
        joined = a.join(b, a[f"`{key}`"].eqNullSafe(b["__key"]), "inner").drop("__key")
    else:
        joined = split_join(a, b, key, "__key", hot_rows).drop("__key")
    if require_match and joined.isEmpty():
        raise ValueError(f"no row matches on {key!r}")
    return joined
