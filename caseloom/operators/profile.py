"""Column profiles, data-quality alerts and single-column detail."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from caseloom.functions.columns import (
    PRODUCT_PREFIX, col, finite, is_numeric, number, numeric_columns, resolve_column,
    split_text_derived,
)
from caseloom.functions.values import parse_number, sample_skewness
from caseloom.operators.quantiles import exact_medians, exact_quantiles

MISSING_ALERT_PCT = 30
HISTOGRAM_BINS = 10
TOP_VALUES = 10
MAX_OPTIONS = 50
NUMERIC_TEXT_SHARE = 0.8
#: Deviation of the sketch that leaves out columns with repeated texts; eight deviations below the rows still count.
SKETCH_ERROR = 0.02


def present(field: T.StructField) -> Column:
    """The column with NaN as NULL."""
    value = col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def value_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """`column, value, number, n`: how often each non-null value occurs; `value` is its text.

    Equal values are combined before the shuffle, so a frequent value costs one row per task.  Numbers
    are compared as numbers and turned into text only once per distinct value.
    """
    wanted = set(df.columns if columns is None else columns)
    fields = [f for f in df.schema if f.name in wanted]

    def entry(i: int, f: T.StructField) -> Column:
        kind = f.dataType.typeName()
        whole = kind in ("byte", "short", "integer", "long")
        parts = {"whole": ("bigint", whole), "real": ("double", kind == "double"), "text": ("string", not whole and kind != "double")}
        return F.struct(F.lit(i).alias("c"), *[
            (present(f) if used else F.lit(None)).cast(t).alias(name) for name, (t, used) in parts.items()
        ])

    decimals = [i for i, f in enumerate(fields) if is_numeric(f.dataType)]
    filled = F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False))
    counted = (
        df.select(F.inline(F.array(*[entry(i, f) for i, f in enumerate(fields)]))).where(filled)
        .groupBy("c", "whole", "real", "text").agg(F.count("*").alias("n"))
    )
    return counted.select(
        F.get(F.array(*[F.lit(f.name) for f in fields]), F.col("c")).alias("column"),
        F.coalesce(F.col("whole").cast("string"), F.col("real").cast("string"), F.col("text")).alias("value"),
        F.coalesce(
            F.col("whole").cast("double"), F.col("real"), F.when(F.col("c").isin(*decimals), F.col("text").try_cast("double"))
        ).alias("number"), "n",
    )


def _first_values(counts: DataFrame, limit: int, order: Sequence[Column]) -> DataFrame:
    """`column, values`: the first `limit` values per column; the top-k runs before the shuffle."""
    ranked = counts.withColumn("pos", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return (
        ranked.where(F.col("pos") <= limit).groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("found"))
        .select("column", F.transform("found", lambda x: x["value"]).alias("values"))
    )


def _one_row_per_column(df: DataFrame, fields: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over the table, turned into one row per column."""
    flat = df.agg(*[e.alias(f"{i}_{k}") for i, parts in enumerate(fields.values()) for k, e in parts.items()])
    return flat.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column"), *[F.col(f"{i}_{k}").alias(k) for k in parts])
        for i, (name, parts) in enumerate(fields.items())
    ])))


def _distinct_counts(df: DataFrame) -> DataFrame:
    return value_counts(df).groupBy("column").agg(F.count("*").alias("unique_count"))


def column_info(df: DataFrame) -> DataFrame:
    """`name, dtype, unique_count, sample_values, missing_count` per column, in column order."""
    counts = value_counts(df)
    distinct = counts.groupBy("column").agg(F.count("*").alias("unique_count"))
    samples = _first_values(counts, 3, [F.col("number").asc_nulls_first(), F.col("value")])
    base = _one_row_per_column(df, {
        f.name: {"dtype": F.first(F.lit(f.dataType.simpleString())), "missing_count": F.count("*") - F.count(present(f))}
        for f in df.schema
    })
    return base.join(distinct, "column", "left").join(samples, "column", "left").select(
        "ordinal", F.col("column").alias("name"),
        F.coalesce("dtype", F.lit("")).alias("dtype"),
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
        F.coalesce("values", F.array().cast("array<string>")).alias("sample_values"),
        F.col("missing_count").cast("bigint").alias("missing_count"),
    ).orderBy("ordinal").drop("ordinal")


def dataset_summary(df: DataFrame) -> DataFrame:
    """Column info with the table's row and column counts on each row."""
    rows = df.agg(F.count("*").alias("n_rows"))
    return column_info(df).select(
        rows.scalar().alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_cols"), "*"
    )


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, missing share, distinct count and mean/min/max/median (2 dp) per column.

    `exact=False` uses sketches for the median and the distinct count: one pass, no shuffle of values.
    """
    numeric = numeric_columns(df, booleans=True)
    medians = exact_medians(df, numeric) if exact else {}

    def parts(f: T.StructField) -> dict[str, Column]:
        value = number(f.name) if f.name in numeric else F.lit(None).cast("double")
        median = F.first(F.lit(medians.get(f.name)).cast("double")) if exact else F.percentile_approx(value, 0.5)
        return {
            "missing_count": F.count("*") - F.count(present(f)),
            "missing_pct": F.coalesce(
                F.try_divide((F.count("*") - F.count(present(f))) * F.lit(100.0), F.count("*")), F.lit(0.0)
            ),
            "mean": F.avg(value), "min": F.min(value), "max": F.max(value), "median": median,
            "approx_unique": F.lit(None).cast("bigint") if exact else F.approx_count_distinct(present(f)),
        }

    base = _one_row_per_column(df, {f.name: parts(f) for f in df.schema})
    if exact:
        base = base.join(_distinct_counts(df), "column", "left")
    else:
        base = base.withColumn("unique_count", F.col("approx_unique"))
    return base.select(
        "ordinal", F.col("column").alias("name"),
        F.when(F.col("column").isin(*numeric), "Numeric").otherwise("Categorical").alias("type"),
        F.bround("missing_pct", 1).alias("missing_pct"),
        F.col("missing_count").cast("bigint").alias("missing_count"),
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
        *[F.bround(c, 2).alias(c) for c in ("mean", "min", "max", "median")],
    ).orderBy("ordinal").drop("ordinal")


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, `__h0` and `__h1`: equal for rows that count as equal (nulls, NaN, both zeros)."""
    parts = []
    for f in df.schema:
        value = col(f.name) + F.lit(0.0).cast(f.dataType) if f.dataType.typeName() in ("double", "float") else col(f.name)
        parts += [col(f.name).isNull(), value]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"__h{seed}") for seed in (0, 1)]


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row, `duplicates`: rows beyond the first of each set of equal rows (nulls are equal).

    Rows are told by two 64-bit hashes, so that sixteen bytes of each are shuffled and not the row.
    """
    groups = df.select(*row_hashes(df)).groupBy("__h0", "__h1").agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def _all_distinct(df: DataFrame, columns: Sequence[str], rows: int) -> list[str]:
    """Those of the columns without a repeated value, by two hashes of each value's text."""
    if not columns:
        return []
    texts = [col(c).cast("string") for c in columns]
    entries = F.array(*[F.struct(F.lit(i).alias("c"), *[F.xxhash64(F.lit(seed), t).alias(f"h{seed}") for seed in (0, 1)]) for i, t in enumerate(texts)])
    found = df.select(F.inline(entries)).distinct().groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") == rows).collect()
    return [columns[r["c"]] for r in found]


def alerts(df: DataFrame) -> DataFrame:
    """`code, column, detail`: duplicate_rows, zero_variance, high_missing, unique_text_id.

    One aggregate tells all but repeated rows: a column has one value if its least is its greatest, and a sketch of the
    distinct texts leaves only columns that may be without a repetition, whose values alone are then compared by hashes.
    """
    numeric = numeric_columns(df, booleans=True)

    def parts(f: T.StructField) -> dict[str, Column]:
        value = present(f) if isinstance(f.dataType, T.AtomicType) else present(f).cast("string")
        text = F.lit(None).cast("string") if f.name in numeric else value.cast("string")
        return {
            "n": F.count("*"), "missing": F.count("*") - F.count(present(f)), "single": F.coalesce(F.min(value) == F.max(value), F.lit(False)),
            "least": F.min(value).cast("string"), "about": F.approx_count_distinct(text, SKETCH_ERROR),
        }

    pct = F.bround(F.try_divide(F.col("missing") * F.lit(100.0), F.col("n")), 1)
    base = _one_row_per_column(df, {f.name: parts(f) for f in df.schema}).withColumns({"pct": pct.cast("string"), "many": pct > MISSING_ALERT_PCT})
    rows = base.collect()
    maybe = [r["column"] for r in rows if r["column"] not in numeric and r["n"] and not r["missing"] and r["about"] >= (1 - 8 * SKETCH_ERROR) * r["n"]]
    unique = set(_all_distinct(df, maybe, rows[0]["n"] if rows else 0))
    found = [("zero_variance", r["column"], r["least"]) for r in rows if r["single"]] + [("high_missing", r["column"], r["pct"]) for r in rows if r["many"]]
    found += [("unique_text_id", r["column"], str(r["n"])) for r in rows if r["column"] in unique]
    duplicated = duplicate_count(df).where("duplicates > 0").select(
        F.lit("duplicate_rows").alias("code"), F.lit(None).cast("string").alias("column"),
        F.col("duplicates").cast("string").alias("detail"),
    )
    return duplicated.unionByName(df.sparkSession.createDataFrame(found, "code string, column string, detail string"))


def dataset_totals(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, numeric features (boolean left out)."""
    missing = sum((F.count("*") - F.count(present(f)) for f in df.schema), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.first(F.lit(len(df.columns))).cast("bigint").alias("n_cols"),
        missing.cast("bigint").alias("missing_values"),
        F.first(F.lit(len(numeric_columns(df)))).cast("bigint").alias("numeric_features"),
    )


def health_report(df: DataFrame, exact: bool = True) -> dict[str, DataFrame]:
    """`totals`: one row; `columns`: one row per column, with "-" as text for non-numeric figures.

    With `exact=False` distinct values are counted by sketches (a deviation of about SKETCH_ERROR), in the one aggregate
    that all other figures come from.
    """
    cells = F.greatest(F.col("n_rows") * F.col("n_cols"), F.lit(1))
    totals = dataset_totals(df).select(
        "n_rows", "n_cols", F.col("missing_values").alias("missing_cells"),
        F.bround(F.col("missing_values") * 100.0 / cells, 2).alias("missing_pct"),
        duplicate_count(df).scalar().alias("duplicates"),
    )
    numeric = numeric_columns(df)

    def parts(f: T.StructField) -> dict[str, Column]:
        value = number(f.name) if f.name in numeric else F.lit(None).cast("double")
        return {
            "n": F.count("*"), "missing": F.count("*") - F.count(present(f)),
            "mean": F.avg(value), "min": F.min(value), "max": F.max(value),
            **({} if exact else {"unique_count": F.approx_count_distinct(present(f).cast("string"), SKETCH_ERROR)}),
        }

    def shown(name: str) -> Column:
        text = F.format_string("%.2f", F.col(name))
        return F.when(~F.col("column").isin(*numeric), "-").otherwise(
            F.when(F.col(name).isNull(), "N/A").otherwise(text)
        ).alias(name)

    dtypes = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    columns = _one_row_per_column(df, {f.name: parts(f) for f in df.schema})
    columns = columns.join(_distinct_counts(df), "column", "left") if exact else columns
    return {
        "totals": totals,
        "columns": columns.select(
            "ordinal", F.col("column").alias("name"), dtypes[F.col("column")].alias("dtype"),
            F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
            F.col("missing").cast("bigint").alias("missing_count"),
            F.bround(F.col("missing") * 100.0 / F.greatest("n", F.lit(1)), 1).alias("missing_pct"),
            shown("mean"), shown("min"), shown("max"),
        ).orderBy("ordinal").drop("ordinal"),
    }


def as_numeric_if_mostly(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """`value` of one column without nulls; text becomes double when >= 80 % of it parses."""
    field = df.schema[name]
    data = df.select(present(field).alias("value")).where(F.col("value").isNotNull())
    if isinstance(field.dataType, T.BooleanType):
        return data, False
    if is_numeric(field.dataType):
        return data.select(F.col("value").cast("double").alias("value")), True
    parsed = parse_number(F.col("value").cast("string"))
    total, good = data.agg(F.count("*"), F.count(parsed)).first()
    if good > 0 and good >= total * NUMERIC_TEXT_SHARE:
        return data.select(parsed.alias("value")).where(F.col("value").isNotNull()), True
    return data, False


def numeric_coercion(df: DataFrame, name: str) -> DataFrame:
    """One row: how many non-null values of the column parse as numbers, and whether it counts as numeric."""
    value = col(name).cast("string")
    good, total = F.count(parse_number(value)), F.count(value)
    return df.agg(
        total.alias("n_values"), good.alias("n_numeric"),
        ((good > 0) & (good >= total * NUMERIC_TEXT_SHARE)).alias("is_numeric"),
    )


def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin from 0; a value on an inner edge belongs to the bin above, the maximum to the last."""
    width = (high - low) / bins
    guess = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
    return (
        F.when(value < low + guess * width, guess - 1)
        .when((value >= low + (guess + 1) * width) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    ).cast("int")


def histograms(df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """`column, bin_idx, lo, hi, count` for numeric columns; empty bins are kept.

    Two passes: the ranges, then one count per (column, bin) that is combined before the shuffle.
    """
    schema = "column string, bin_idx int, lo double, hi double, count bigint"
    finite_values = {c: finite(c, T.DoubleType()) for c in columns}
    data = df.select(*[col(c).cast("double").alias(c) for c in columns]).select(*finite_values.values())
    bounds = data.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))]).first()
    ranges = {}
    for i, c in enumerate(columns):
        low, high = bounds[f"a{i}"], bounds[f"b{i}"]
        if low is not None:
            ranges[c] = (low - 0.5, high + 0.5) if low == high else (low, high)
    spark = df.sparkSession
    if not ranges:
        return spark.createDataFrame([], schema)
    entries = [
        F.struct(F.lit(c).alias("column"), bin_index(col(c), lo, hi, bins).alias("bin_idx"))
        for c, (lo, hi) in ranges.items()
    ]
    counted = (
        data.select(F.inline(F.array(*entries))).where(F.col("bin_idx").isNotNull())
        .groupBy("column", "bin_idx").agg(F.count("*").alias("count"))
    )
    edges = spark.createDataFrame(
        [(c, i, lo + i * (hi - lo) / bins, hi if i == bins - 1 else lo + (i + 1) * (hi - lo) / bins)
         for c, (lo, hi) in ranges.items() for i in range(bins)],
        "column string, bin_idx int, lo double, hi double",
    )
    return edges.join(counted, ["column", "bin_idx"], "left").select(
        "column", "bin_idx", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


def iqr_bounds(quantiles: dict[float, float | None]) -> tuple[float, float] | None:
    low, high = quantiles[0.25], quantiles[0.75]
    if low is None or high is None:
        return None
    reach = 1.5 * (high - low)
    return low - reach, high + reach


def top_values(df: DataFrame, name: str, limit: int = TOP_VALUES) -> DataFrame:
    """`value, count` of the most frequent values; ties in value order."""
    return (
        df.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value"))
        .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)
    )


def column_detail(df: DataFrame, name: str) -> dict[str, DataFrame]:
    """`summary` (name, type, skewness, outliers_count, total_count) and `distribution` of one column."""
    name = resolve_column(df, name)
    data, numeric = as_numeric_if_mostly(df, name)
    if numeric:
        values = data.select(finite("value", T.DoubleType())).where(F.col("value").isNotNull())
        quantiles = exact_quantiles(values, ["value"], [0.25, 0.75])["value"]
        bounds = iqr_bounds(quantiles)
        spread = bounds is not None and quantiles[0.75] > quantiles[0.25]
        outside = F.count_if((F.col("value") < bounds[0]) | (F.col("value") > bounds[1])) if spread else F.lit(0)
        summary = values.agg(
            F.bround(sample_skewness(F.col("value")), 2).alias("skewness"),
            outside.cast("bigint").alias("outliers_count"), F.count("*").alias("total_count"),
        ).select(
            F.lit(name).alias("name"), F.when(F.col("total_count") == 0, "Empty").otherwise("Numeric").alias("type"), "*")
        return {"summary": summary, "distribution": histograms(values, ["value"]).drop("column")}
    kind = F.when(F.col("total_count") == 0, "Empty").otherwise("Categorical")
    summary = data.agg(F.count("*").alias("total_count")).select(
        F.lit(name).alias("name"), kind.alias("type"), F.lit(0.0).alias("skewness"),
        F.lit(0).cast("bigint").alias("outliers_count"), "total_count",
    )
    return {"summary": summary, "distribution": top_values(data, "value")}


def feature_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`name, is_numeric, min, max, mean, options` for a scoring form; at most 50 options, sorted."""
    names = list(df.columns if columns is None else columns)
    data = df.select(*[col(c) for c in names])
    numeric = numeric_columns(data, booleans=True)
    base = _one_row_per_column(data, {
        c: {k: f(number(c)) if c in numeric else F.first(F.lit(None).cast("double"))
            for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))}
        for c in names
    })
    texts = [c for c in names if c not in numeric]
    if texts:
        options = _first_values(value_counts(data, texts), MAX_OPTIONS, [F.col("value")])
        base = base.join(options.withColumnRenamed("values", "options"), "column", "left")
    else:
        base = base.withColumn("options", F.lit(None).cast("array<string>"))
    return base.select(
        "ordinal", F.col("column").alias("name"), F.col("column").isin(*numeric).alias("is_numeric"),
        "min", "max", "mean", "options",
    ).orderBy("ordinal").drop("ordinal")


def feature_defaults(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`name, number, text`: mean of numeric, mode of text (ties: smallest), 0 for text-derived columns."""
    names = list(df.columns if columns is None else columns)
    plain, derived = split_text_derived(names)
    data = df.select(*[col(c) for c in names])
    numeric = numeric_columns(data, booleans=True)
    base = _one_row_per_column(data, {
        c: {"number": F.first(F.lit(0.0)) if c in derived
            else F.coalesce(F.avg(number(c)), F.lit(0.0)) if c in numeric else F.first(F.lit(None).cast("double"))}
        for c in names
    })
    texts = [c for c in plain if c not in numeric]
    if texts:
        modes = _first_values(value_counts(data, texts), 1, [F.desc("n"), F.col("value")])
        base = base.join(modes, "column", "left").withColumn(
            "text", F.when(F.col("column").isin(*texts), F.coalesce(F.get("values", F.lit(0)), F.lit("")))
        )
    else:
        base = base.withColumn("text", F.lit(None).cast("string"))
    return base.orderBy("ordinal").select(F.col("column").alias("name"), "number", "text")


def scoring_schema(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Form fields of a scoring request: product flags become one `product` field, text-derived
    columns one `case_description` field, and the SLA targets are left out."""
    names = list(df.columns if columns is None else columns)
    plain, derived = split_text_derived(names)
    products = [c for c in plain if c.lower().startswith(PRODUCT_PREFIX)]
    hidden = {*products, "target_solution_hours", "resolution_hours"}
    schema = "name string, is_numeric boolean, is_text boolean, min double, max double, mean double, options array<string>"
    virtual = []
    if derived:
        virtual.append(("case_description", False, True, None, None, None, None))
    if products:
        options = sorted({c[len(PRODUCT_PREFIX):] for c in products if c[len(PRODUCT_PREFIX):].strip()})
        virtual.append(("product", False, False, None, None, None, options))
    shown = [c for c in plain if c not in hidden]
    head = df.sparkSession.createDataFrame(virtual, schema)
    if not shown:
        return head
    return head.unionByName(feature_info(df, shown).withColumn("is_text", F.lit(False)))
