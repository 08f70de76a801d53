"""Two-column comparison, pivots and exploratory data."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from caseloom.functions.columns import col, is_numeric, number, numeric_columns, require_columns
from caseloom.operators.profile import histograms
from caseloom.operators.quantiles import grouped_quantiles

SCATTER_ROWS = 1000
MAX_CELLS = 200
TOP_FEATURES = 6
AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, `correlation`: Pearson r over rows where both are present."""
    return df.agg(F.corr(number(a), number(b)).alias("correlation"))


def scatter_sample(df: DataFrame, a: str, b: str, rows: int = SCATTER_ROWS, seed: int = 42) -> DataFrame:
    """At most `rows` complete pairs, drawn by rows: a pair that repeats is drawn as often as it occurs.

    Each row's hash includes its number, so equal rows do not stand together.  A top-k, no shuffle.
    """
    row = F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *[col(c) for c in df.columns])
    pairs = df.select(col(a), col(b), row.alias("__row")).dropna()
    return pairs.orderBy("__row").limit(rows).drop("__row")


def describe_by(df: DataFrame, category: str, value: str) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max of `value` per category; null categories are left out."""
    v = number(value)
    moments = df.where(col(category).isNotNull()).groupBy(col(category)).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    quartiles = grouped_quantiles(df, [category], value, [0.25, 0.5, 0.75])
    named = quartiles.withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    return moments.join(named, category, "left").select(
        col(category), "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """`a, b, count` of the pairs that occur; rows with a null in either are left out."""
    return df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a), col(b)).agg(F.count("*").alias("count"))


def crosstab(df: DataFrame, a: str, b: str, max_cells: int = MAX_CELLS) -> DataFrame:
    """Wide, zero-filled contingency table; refused beyond `max_cells` cells."""
    pairs = contingency(df, a, b)
    rows, columns = pairs.agg(F.count_distinct(col(a)), F.count_distinct(col(b))).first()
    if rows * columns > max_cells:
        raise ValueError(f"too many combinations to show: {rows} x {columns} = {rows * columns} cells")
    values = [r[0] for r in pairs.select(col(b)).distinct().orderBy(col(b)).collect()]
    return pairs.groupBy(col(a)).pivot(b, values).agg(F.sum("count")).na.fill(0)


def group_aggregate(df: DataFrame, category: str, value: str, how: str = "mean") -> DataFrame:
    """`category, value`: mean, sum, count, min or max per category, 2 dp, without null results."""
    require_columns(df, [category, value])
    how = how.lower()
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}; choose from {sorted(AGGREGATES)}")
    v = number(value)
    if how == "sum":
        v = F.coalesce(v, F.lit(0.0))
    grouped = df.where(col(category).isNotNull()).groupBy(col(category).alias("category")).agg(AGGREGATES[how](v).alias("value"))
    return grouped.select("category", F.bround(F.col("value").cast("double"), 2).alias("value")).where(F.col("value").isNotNull())


def _correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """`a, b, r` for each pair, over its rows without missing values, in two scans for any number of columns.

    The first finds the means.  In the second each task adds up matrices of the centred values, their squares and their
    presence, from which the sums over every pair's own rows follow; they are added up by cell.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    data = df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(names)])
    finite = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in data.columns}
    found = data.agg(*[f(v) for f in (F.avg, F.stddev_pop) for v in finite.values()]).first()
    means = np.array([m or 0.0 for m in found[:len(names)]])
    spreads = np.array([s or 1.0 for s in found[len(names):]])
    # The pairs' cells; a target's column with each feature needs one row of the matrices only.
    firsts = sorted({names.index(a) for a, _ in pairs}) if len({b for _, b in pairs}) > 1 else [names.index(a) for a, _ in pairs]
    seconds = sorted({names.index(b) for _, b in pairs})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(firsts), len(seconds)))
        for batch in batches:
            raw = (batch.to_numpy(dtype=float) - means) / spreads
            there = ~np.isnan(raw)
            x, p = np.where(there, raw, 0.0), there.astype(float)
            xa, xb, pa, pb = x[:, firsts], x[:, seconds], p[:, firsts], p[:, seconds]
            with np.errstate(invalid="ignore"):
                total += np.stack([pa.T @ pb, xa.T @ pb, pa.T @ xb, (xa * xa).T @ pb, pa.T @ (xb * xb), xa.T @ xb])
        i, j = np.meshgrid(firsts, seconds, indexing="ij")
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), **{f"s{k}": t.ravel() for k, t in enumerate(total)}})

    sums = ", ".join(f"s{k} double" for k in range(6))
    cells = data.mapInPandas(partial, f"i int, j int, {sums}").groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    n, sa, sb, qa, qb, ab = (F.col(f"s{k}") for k in range(6))
    # Rounding leaves traces of a constant's spread.
    spread = F.sqrt(F.greatest(qa - sa * sa / n, F.lit(0.0))) * F.sqrt(F.greatest(qb - sb * sb / n, F.lit(0.0)))
    r = F.when((n > 0) & (spread > 1e-9 * n), (ab - sa * sb / n) / spread)
    r = F.when(r.isNotNull(), F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))))
    wanted = df.sparkSession.createDataFrame([(names.index(a), names.index(b), a, b) for a, b in pairs], "i int, j int, a string, b string")
    return wanted.join(cells, ["i", "j"], "left").select("a", "b", F.nanvl(r, F.lit(None).cast("double")).alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`a, b, r` for all ordered pairs of numeric columns, each over its complete rows."""
    names = list(columns or numeric_columns(df))
    half = _correlations(df, list(combinations_with_replacement(names, 2)))
    both = F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return half.select(F.inline(F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)))


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """`feature, r` of each numeric column with the target, highest first."""
    features = numeric_columns(df, but=[target])
    return (
        _correlations(df, [(f, target) for f in features]).select(F.col("a").alias("feature"), "r")
        .orderBy(F.desc_nulls_last("r"), "feature")
    )


def top_correlated(df: DataFrame, target: str, limit: int = TOP_FEATURES) -> DataFrame:
    """The features with the largest absolute correlation with the target."""
    strength = F.abs("r").alias("abs_r")
    return (
        target_correlations(df, target).where(F.col("r").isNotNull()).select("feature", "r", strength)
        .orderBy(F.desc("abs_r"), "feature").limit(limit)
    )


def feature_histograms(df: DataFrame, target: str | None = None, bins: int = 10) -> DataFrame:
    return histograms(df, numeric_columns(df, but=[target] if target else []), bins)


def density_curve(df: DataFrame, name: str, points: int = 200) -> DataFrame:
    """`x, density`: Gaussian kernel density (Scott's bandwidth) on an even grid over the range.

    Tasks sum the kernel over their own rows, so only `points` numbers per task are shuffled.
    """
    data = df.select(number(name).alias("v")).where(F.col("v").isNotNull())
    n, std, low, high = data.agg(F.count("v"), F.stddev_samp("v"), F.min("v"), F.max("v")).first()
    schema = "x double, density double"
    if not n or not std:
        return df.sparkSession.createDataFrame([], schema)
    width = std * n ** (-1 / 5)
    grid = np.linspace(low - 3 * width, high + 3 * width, points)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(points)
        for batch in batches:
            values = batch["v"].to_numpy()
            for start in range(0, len(values), 10_000):
                z = (grid[:, None] - values[None, start:start + 10_000]) / width
                sums += np.exp(-0.5 * z * z).sum(axis=1)
        yield pd.DataFrame({"i": np.arange(points), "s": sums})

    scale = n * width * math.sqrt(2 * math.pi)
    step = (grid[-1] - grid[0]) / (points - 1)
    return (
        data.mapInPandas(partial, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s"))
        .select((F.lit(float(grid[0])) + F.col("i") * step).alias("x"), (F.col("s") / scale).alias("density"))
    )


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """`value, count`: every value of the column, null included."""
    return df.groupBy(col(name).alias("value")).agg(F.count("*").alias("count"))


def compare_columns(df: DataFrame, a: str, b: str) -> dict[str, DataFrame]:
    """The comparison that fits the two types: scatter, boxplot or crosstab data."""
    require_columns(df, [a, b])
    kinds = [is_numeric(df.schema[c].dataType, booleans=True) for c in (a, b)]
    if all(kinds):
        return {"correlation": correlation(df, a, b), "scatter": scatter_sample(df, a, b)}
    if any(kinds):
        category, value = (b, a) if kinds[0] else (a, b)
        return {"boxplot": describe_by(df, category, value)}
    return {"crosstab": contingency(df, a, b)}


def target_views(df: DataFrame, target: str, problem_type: str, limit: int = TOP_FEATURES) -> dict[str, DataFrame]:
    """For the top correlated features: box data per class, or scatter data for a regression."""
    names = [r["feature"] for r in top_correlated(df, target, limit).collect()]
    if problem_type == "classification":
        return {c: describe_by(df, target, c) for c in names}
    return {c: scatter_sample(df, c, target) for c in names}
