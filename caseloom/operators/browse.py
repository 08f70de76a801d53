"""Looking at rows: preview, free-text search and pages."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, functions as F

from caseloom.functions.columns import col, finite, require_columns

DEEP_PAGE_ROWS = 100_000
#: Ranges counted in one round of narrowing.
CUTS = 24


def preview(df: DataFrame, rows: int | None = None, order_by: str | None = None) -> DataFrame:
    """All rows, or the first `rows` (by `order_by` where given), with NaN and infinities as NULL."""
    clean = df.select(*[finite(f.name, f.dataType) for f in df.schema])
    if order_by:
        clean = clean.orderBy(col(order_by))
    return clean if rows is None else clean.limit(rows)


def search_rows(df: DataFrame, term: str) -> DataFrame:
    """Rows where any column, as lower-case text, contains the term; a blank term keeps all."""
    if not term.strip():
        return df
    needle = term.lower()
    return df.where(reduce(or_, [F.lower(col(c).cast("string")).contains(needle) for c in df.columns]))


def page_count(df: DataFrame, size: int) -> int:
    return max(1, math.ceil(df.count() / size))


def paginate(
    df: DataFrame, key: str | list[str], page: int = 1, size: int = 15, deep: int = DEEP_PAGE_ROWS
) -> DataFrame:
    """Page `page` (from 1) of `df` in the order of `key`, keys of any type, missing ones last.

    Near the start this is a top-k.  Beyond `deep` rows the key range that holds the page is found by counting rows
    between cuts drawn from a sample, round by round; only that range is sorted.  Rows with equal keys are told apart by
    a hash of the row, so a frequent key is narrowed too.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(df, keys)
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    offset = (page - 1) * size
    order = [col(k).asc_nulls_last() for k in keys]
    if offset + size > deep:
        rows, before = _page_range(df, keys, offset, size, max(deep, 4 * CUTS))
        return rows.orderBy("__place").drop("__place").offset(offset - before).limit(size)
    return df.orderBy(*order).offset(offset).limit(size)


def _page_range(df: DataFrame, keys: list[str], offset: int, size: int, most: int) -> tuple[DataFrame, int]:
    """Rows (with `__place`, their place as a struct) of a key range of about `most` rows around the page, and how many lie before."""
    names = [part for i in range(len(keys)) for part in (f"m{i}", f"k{i}")]
    parts = [part for k in keys for part in (col(k).isNull(), col(k))] + [F.xxhash64(*[col(c) for c in df.columns])]
    place = F.struct(*[p.alias(n) for p, n in zip(parts, [*names, "row"])])
    rows = df.withColumn("__place", place)
    kinds, before, inside = rows.schema["__place"].dataType, 0, df.count()
    low = high = None

    def literal(value: Row) -> Column:
        return F.struct(*map(F.lit, value)).cast(kinds)

    def first_key(edge: Row, keep: Column) -> Column:
        """A plain filter on the first key, implied by the range, that reaches the scan."""
        missing, value = edge[0], edge[1]
        return F.lit(True) if missing or value != value else keep

    def within(data: DataFrame) -> DataFrame:
        first = col(keys[0])
        if low is not None:
            at_least = first >= F.lit(low[1]) if high is not None and not high[0] else (first >= F.lit(low[1])) | first.isNull()
            data = data.where(first_key(low, at_least)).where(F.col("__place") >= literal(low))
        return data if high is None else data.where(first_key(high, first <= F.lit(high[1]))).where(F.col("__place") < literal(high))

    def bucket_of(cuts: list[Row], base: int = 0) -> Column:
        """How many cuts lie at or before a row's place, by bisection."""
        if not cuts:
            return F.lit(base)
        half = len(cuts) // 2
        return F.when(F.col("__place") < literal(cuts[half]), bucket_of(cuts[:half], base)).otherwise(bucket_of(cuts[half + 1:], base + half + 1))

    while inside > most:
        drawn = within(rows).select("__place").sample(min(1.0, 32.0 * CUTS / inside), seed=7).orderBy("__place").collect()
        sample = list(dict.fromkeys(r[0] for r in drawn))
        cuts = sample[len(sample) // CUTS::max(1, len(sample) // CUTS)] if sample else []
        if not cuts:
            break
        counts = dict(within(rows).groupBy(bucket_of(cuts).alias("b")).count().collect())
        first, upto = 0, before
        while first < len(cuts) and upto + counts.get(first, 0) <= offset:
            upto, first = upto + counts.get(first, 0), first + 1
        last, end = first, upto + counts.get(first, 0)
        while last < len(cuts) and end < offset + size:
            last, end = last + 1, end + counts.get(last + 1, 0)
        if end - upto >= inside:
            break
        low, high = cuts[first - 1] if first else low, cuts[last] if last < len(cuts) else high
        before, inside = upto, end - upto
    return within(rows), before
