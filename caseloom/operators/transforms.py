"""Log targets, sqrt/log feature variants, outliers and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import col, is_numeric, number, numeric_columns
from caseloom.functions.values import sample_skewness
from caseloom.operators.profile import iqr_bounds
from caseloom.operators.quantiles import exact_quantiles

SKEW_THRESHOLD = 1.0
ROBUST_SHARE = 0.3


def needs_log(df: DataFrame, target: str, problem_type: str, threshold: float = SKEW_THRESHOLD) -> bool:
    """Whether a numeric regression target is right-skewed; a target with values <= -1 is an error."""
    if problem_type != "regression" or not is_numeric(df.schema[target].dataType):
        return False
    value = number(target)
    skew, low = df.agg(sample_skewness(value), F.count_if(value <= -1)).first()
    if skew <= threshold:
        return False
    if low:
        raise ValueError(f"{target!r} is skewed but has {low} values <= -1, so it has no log transform")
    return True


def log_target(df: DataFrame, target: str, problem_type: str = "regression") -> tuple[DataFrame, str, bool]:
    """Adds `{target}_log` where the target is right-skewed; returns the target column to use."""
    if not needs_log(df, target, problem_type):
        return df, target, False
    name = f"{target}_log"
    return df.withColumn(name, F.log1p(number(target))), name, True


def non_negative_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose values are all present and >= 0; one aggregate."""
    if not columns:
        return []
    row = df.agg(*[(F.count_if(number(c) >= 0) == F.count("*")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for c, ok in zip(columns, row) if ok]


def sqrt_of(value: Column) -> Column:
    """Square root; 0 for a negative or missing value."""
    return F.when(value >= 0, F.sqrt(value)).otherwise(0.0)


def log_of(value: Column) -> Column:
    """log(1 + x); 0 for a negative or missing value."""
    return F.when(value >= 0, F.log1p(value)).otherwise(0.0)


VARIANTS = {"_sqrt": sqrt_of, "_log": log_of}


def add_variants(df: DataFrame, target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Adds `{c}_sqrt` and `{c}_log` for every numeric feature without negative or missing values."""
    bases = non_negative_columns(df, numeric_columns(df, but=[target] if target else []))
    added = {f"{c}{suffix}": make(number(c)) for c in bases for suffix, make in VARIANTS.items()}
    return df.select("*", *[e.alias(n) for n, e in added.items()]), list(added)


def derive_variants(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds the `_sqrt` / `_log` columns among `features` that the table lacks but has the base of."""
    extra = []
    for name in features:
        if name in df.columns:
            continue
        for suffix, make in VARIANTS.items():
            base = name.removesuffix(suffix)
            if base != name and base in df.columns:
                extra.append(make(number(base)).alias(name))
                break
    return df.select("*", *extra) if extra else df


def outlier_counts(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """`column, n_outliers` by the 1.5 IQR rule, only columns that have some, most first."""
    names = list(columns) if columns is not None else numeric_columns(df, but=[target] if target else [])
    bounds = {c: b for c, q in exact_quantiles(df, names, [0.25, 0.75]).items() if (b := iqr_bounds(q))}
    schema = "column string, n_outliers bigint"
    if not bounds:
        return df.sparkSession.createDataFrame([], schema)
    flat = df.agg(*[
        F.count_if((number(c) < low) | (number(c) > high)).alias(f"n{i}") for i, (c, (low, high)) in enumerate(bounds.items())
    ])
    return (
        flat.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_outliers")) for i, c in enumerate(bounds)
        ])))
        .where("n_outliers > 0").orderBy(F.desc("n_outliers"), "column")
    )


def choose_scaler(columns_with_outliers: int, features: int) -> str:
    """`robust` when at least 30 % of the features have outliers, else `standard`."""
    return "robust" if features and columns_with_outliers / features >= ROBUST_SHARE else "standard"


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean, unit population deviation; a constant column is only centred."""
    stats = df.agg(
        *[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(number(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    centre = {c: (stats[f"m{i}"], stats[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    return _scaled(df, centre)


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median 0, interquartile range 1; a column without spread is only centred."""
    quantiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    centre = {
        c: (q[0.5], (q[0.75] - q[0.25]) or 1.0) for c, q in quantiles.items() if q[0.5] is not None
    }
    return _scaled(df, centre)


def _scaled(df: DataFrame, centre: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[
        ((number(c) - centre[c][0]) / centre[c][1]).alias(c) if c in centre and centre[c][0] is not None else col(c)
        for c in df.columns
    ])
