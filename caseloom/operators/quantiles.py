"""Exact quantiles that never gather an unbounded set of values in one task.

Spark's `percentile` keeps every distinct value of a column in one aggregation buffer.  It is used here
only below a checked number of values.  Beyond that the wanted ranks are narrowed round by round: a
mergeable sketch proposes cuts around each rank, an exact count says between which cuts the rank lies,
and the next round looks only there.  Every pass is one scan whose partial results are small.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.columns import col, finite_number as number

EXACT_ROWS = 200_000      # values of one column that `percentile` may hold
EXACT_TOTAL = 2_000_000   # values of all columns of one job
SKETCH_ACCURACY = 10_000
SLACK = 2.0 / SKETCH_ACCURACY
Range = tuple[float | None, float | None, int, int]  # low, high (both outside), values <= low, values inside


def order_statistics(
    df: DataFrame, wanted: dict[str, Sequence[int]], sizes: dict[str, int]
) -> dict[tuple[str, int], float]:
    """The values at the given 0-based ranks of each (non-null, numeric) column; all are actual values."""
    open_ranks: dict[tuple[str, int], Range] = {
        (c, r): (None, None, 0, sizes[c]) for c, rs in wanted.items() for r in rs
    }
    found: dict[tuple[str, int], float] = {}
    data = df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(wanted)])
    names = {c: f"v{i}" for i, c in enumerate(wanted)}
    while open_ranks:
        cuts = _proposed_cuts(data, names, open_ranks)
        counts = _counts_between(data, names, cuts)
        for (c, r) in list(open_ranks):
            below = 0
            for i, n in enumerate(counts[c]):
                if r < below + n:
                    break
                below += n
            # Buckets alternate: between cuts (even), exactly a cut (odd).
            if i % 2:
                found[c, r] = cuts[c][i // 2]
                del open_ranks[c, r]
            else:
                low = cuts[c][i // 2 - 1] if i else None
                high = cuts[c][i // 2] if i // 2 < len(cuts[c]) else None
                open_ranks[c, r] = (low, high, below, n)
    return found


def _proposed_cuts(
    data: DataFrame, names: dict[str, str], open_ranks: dict[tuple[str, int], Range]
) -> dict[str, list[float]]:
    """Sorted values around each open rank, from one sketch per column and range."""
    sketches: dict[tuple[str, Range], list[float]] = {}
    for (c, r), span in open_ranks.items():
        spot = (r - span[2] + 0.5) / span[3]
        sketches.setdefault((c, span), []).extend([max(0.0, spot - SLACK), min(1.0, spot), min(1.0, spot + SLACK)])

    def inside(c: str, span: Range) -> Column:
        value, keep = F.col(names[c]), F.lit(True)
        if span[0] is not None:
            keep = keep & (value > span[0])
        if span[1] is not None:
            keep = keep & (value < span[1])
        return F.when(keep, value)

    row = data.agg(*[
        F.percentile_approx(inside(c, span), shares, SKETCH_ACCURACY).alias(f"s{i}")
        for i, ((c, span), shares) in enumerate(sketches.items())
    ]).first()
    cuts: dict[str, set[float]] = {}
    for i, (c, span) in enumerate(sketches):
        cuts.setdefault(c, set()).update(row[f"s{i}"])
        cuts[c].update(x for x in span[:2] if x is not None)
    return {c: sorted(values) for c, values in cuts.items()}


def _counts_between(data: DataFrame, names: dict[str, str], cuts: dict[str, list[float]]) -> dict[str, list[int]]:
    """Per column the values below the first cut, equal to it, between it and the second, and so on."""
    splits = {
        c: [-math.inf, *[x for v in values for x in (v, math.nextafter(v, math.inf))], math.inf]
        for c, values in cuts.items()
    }
    # Neighbouring doubles leave no room between two cuts: equal split points are merged.
    splits = {c: sorted(set(points)) for c, points in splits.items()}
    columns = list(cuts)
    placed = Bucketizer(
        splitsArray=[splits[c] for c in columns], inputCols=[names[c] for c in columns],
        outputCols=[f"b{i}" for i in range(len(columns))], handleInvalid="keep",
    ).transform(data)
    entries = F.array(*[
        F.struct(F.lit(i).alias("c"), F.when(F.col(names[c]).isNotNull(), F.col(f"b{i}").cast("int")).alias("b"))
        for i, c in enumerate(columns)
    ])
    rows = placed.select(F.inline(entries)).where(F.col("b").isNotNull()).groupBy("c", "b").count().collect()
    counts = {c: [0] * (2 * len(cuts[c]) + 1) for c in columns}
    for r in rows:
        c = columns[r["c"]]
        start = splits[c][r["b"]]
        at = bisect_left(cuts[c], start)
        is_cut = at < len(cuts[c]) and cuts[c][at] == start
        counts[c][2 * at + 1 if is_cut else 2 * at] += r["count"]
    return counts


def _batches(columns: Iterable[str], sizes: dict[str, int], limit: int) -> Iterator[list[str]]:
    batch: list[str] = []
    held = 0
    for c in columns:
        if batch and held + sizes[c] > limit:
            yield batch
            batch, held = [], 0
        batch.append(c)
        held += sizes[c]
    if batch:
        yield batch


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact_rows: int = EXACT_ROWS
) -> dict[str, dict[float, float | None]]:
    """Linear-interpolation quantiles of numeric columns; nulls, NaN and infinities are ignored at every size."""
    columns = list(dict.fromkeys(columns))
    probs = list(probs)
    if not columns:
        return {}
    counted = df.agg(*[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = dict(zip(columns, counted))
    result: dict[str, dict[float, float | None]] = {c: dict.fromkeys(probs) for c in columns}
    small = [c for c in columns if 0 < sizes[c] <= exact_rows]
    for batch in _batches(small, sizes, EXACT_TOTAL):
        row = df.agg(*[F.percentile(number(c), F.array(*map(F.lit, probs))).alias(f"q{i}") for i, c in enumerate(batch)]).first()
        for c, values in zip(batch, row):
            result[c] = dict(zip(probs, values))
    large = [c for c in columns if sizes[c] > exact_rows]
    if large:
        spots = {c: [p * (sizes[c] - 1) for p in probs] for c in large}
        ranks = {c: sorted({f(s) for s in spots[c] for f in (math.floor, math.ceil)}) for c in large}
        values = order_statistics(df, ranks, sizes)
        for c in large:
            for p, spot in zip(probs, spots[c]):
                low, high = values[c, math.floor(spot)], values[c, math.ceil(spot)]
                result[c][p] = low + (high - low) * (spot - math.floor(spot)) if high != low else low
    return result


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0.5] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], exact_rows: int = EXACT_ROWS
) -> DataFrame:
    """`keys..., q0, q1, ...`: exact quantiles per group, also where one group holds most rows.

    Small inputs use Spark's `percentile`.  Otherwise values are counted per (key, value range,
    value), with ranges cut at global quantiles, so a hot group spreads over many tasks.  The number of ranges and
    the sketch's accuracy grow with the rows, so a range does not.  Infinities are ignored.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    data = df.select(*[col(k).alias(a) for k, a in zip(keys, ks)], number(value).alias("v")).dropna()
    names = [F.col(a).alias(k) for k, a in zip(keys, ks)]
    rows = data.count()
    if rows <= exact_rows:
        quantiles = data.groupBy(*ks).agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
        return quantiles.select(*names, *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))])

    ranges = max(16, rows // exact_rows)
    cuts = data.agg(
        F.percentile_approx("v", [i / ranges for i in range(1, ranges)], max(SKETCH_ACCURACY, 4 * ranges)).alias("cuts")
    ).first()["cuts"]
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    ranged = Bucketizer(splits=splits, inputCol="v", outputCol="range").transform(data)
    counted = ranged.groupBy(*ks, "range", "v").agg(F.count("*").alias("n"))
    per_range = counted.groupBy(*ks, "range").agg(F.sum("n").alias("range_n"))
    by_range = Window.partitionBy(*ks).orderBy("range")
    offsets = per_range.select(
        *ks, "range",
        (F.sum("range_n").over(by_range) - F.col("range_n")).alias("offset"),
        F.sum("range_n").over(Window.partitionBy(*ks)).alias("total"),
    )
    within = Window.partitionBy(*ks, "range").orderBy("v")
    placed = counted.join(offsets, [*ks, "range"]).select(
        *ks, "v", "total", "n", (F.col("offset") + F.sum("n").over(within)).alias("upto")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("v")))

    last = F.col("total") - 1
    picked = placed.groupBy(*ks).agg(
        F.max("total").alias("total"),
        *[at(F.floor(last * p)).alias(f"lo{i}") for i, p in enumerate(probs)],
        *[at(F.ceil(last * p)).alias(f"hi{i}") for i, p in enumerate(probs)],
    )
    return picked.select(
        *names,
        *[
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (last * p - F.floor(last * p))).alias(f"q{i}")
            for i, p in enumerate(probs)
        ],
    )
