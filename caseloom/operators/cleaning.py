"""Row and column cleaning with a report of what was done."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.columns import col, number, numeric_columns, require_columns
from caseloom.operators.profile import present, row_hashes
from caseloom.operators.quantiles import exact_medians
from caseloom.operators.splits import content_hash
from caseloom.session import cut_lineage

# Column names that are always identifiers.
ID_COLUMNS = ("id", "patient_id", "index")
#: Repeated rows' hashes up to which they are broadcast.
REPEATED = 100_000


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(present(df.schema[target]).isNotNull())


def drop_duplicates(df: DataFrame, known: int = REPEATED) -> DataFrame:
    """One row of each set of equal rows.

    Two hashes of every row are shuffled first.  Only rows whose hashes occur twice are then moved and compared as a
    whole; the others stay where they are.  With more than `known` repeated hashes all rows are moved.
    """
    if not df.columns:
        return df.dropDuplicates()
    hashed = df.select("*", *row_hashes(df))
    repeated = hashed.groupBy("__h0", "__h1").agg(F.count("*").alias("n")).where("n > 1").select("__h0", "__h1")
    found = repeated.limit(known + 1).collect()
    if not found:
        return df
    if len(found) > known:
        return df.dropDuplicates()
    marks = F.broadcast(df.sparkSession.createDataFrame(found, repeated.schema))
    same = ["__h0", "__h1"]
    alone = hashed.join(marks, same, "left_anti").drop(*same).select(*[col(c) for c in df.columns])
    return alone.union(hashed.join(marks, same, "left_semi").drop(*same).select(*[col(c) for c in df.columns]).dropDuplicates())


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value; one aggregate."""
    filled = df.agg(*[F.count(present(f)).alias(f"n{i}") for i, f in enumerate(df.schema)]).first()
    return [c for c, n in zip(df.columns, filled) if n == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[col(c) for c in empty_columns(df)])


def id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() in ID_COLUMNS]


def drop_id_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[col(c) for c in id_columns(df)])


def fill_numeric(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """Missing numbers (null or NaN) replaced; a whole-number column stays whole if its fill is."""
    def filled(f):
        value = values.get(f.name)
        if value is None:
            return col(f.name)
        whole = f.dataType.typeName() in ("byte", "short", "integer", "long")
        if whole and float(value).is_integer():
            return F.coalesce(col(f.name), F.lit(int(value))).cast(f.dataType).alias(f.name)
        return F.coalesce(number(f.name), F.lit(float(value))).alias(f.name)

    return df.select(*[filled(f) for f in df.schema])


def impute_medians(df: DataFrame, target: str | None = None) -> DataFrame:
    """Missing values of numeric features take the column's exact median."""
    features = numeric_columns(df, but=[target] if target else [])
    return fill_numeric(df, exact_medians(df, features))


def clean_table(
    df: DataFrame, target: str | None = None, impute: bool = True, row_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, report): null targets, duplicate rows, empty and ID columns, median imputation.

    The report has `step, detail, n`.  The rows are shuffled once, to remove duplicates, and written to
    the checkpoint folder; all later figures read only the columns they need from there.  `row_id`
    names an extra column with a hash of each row's content.
    """
    if target:
        require_columns(df, [target])
    steps: list[tuple[str, str | None, int]] = []
    missing_target = F.count("*") - F.count(present(df.schema[target])) if target else F.lit(0)
    rows, dropped = df.agg(F.count("*"), missing_target).first()
    steps += [("initial_rows", None, rows), ("initial_columns", None, len(df.columns))]
    if dropped:
        steps.append(("dropped_null_target", target, dropped))
    kept = drop_duplicates(drop_null_target(df, target) if target else df)
    names = kept.columns
    kept = cut_lineage(kept.withColumn(row_id, content_hash(kept)) if row_id else kept)
    left, *filled = kept.agg(F.count("*"), *[F.count(present(f)) for f in kept.schema]).first()
    if rows - dropped > left:
        steps.append(("removed_duplicates", None, rows - dropped - left))
    counts = dict(zip(kept.columns, filled))
    empty = [c for c in names if counts[c] == 0 and c != target]
    ids = [c for c in id_columns(kept) if c not in empty and c != target]
    steps += [("dropped_empty_column", c, 1) for c in empty] + [("dropped_id_column", c, 1) for c in ids]
    cleaned = kept.drop(*[col(c) for c in [*empty, *ids]])
    if impute:
        gaps = [c for c in numeric_columns(cleaned, but=[target, row_id]) if counts[c] < left]
        if gaps:
            cleaned = fill_numeric(cleaned, exact_medians(cleaned, gaps))
            steps += [("imputed_median", c, left - counts[c]) for c in gaps]
    steps += [("final_rows", None, left), ("final_columns", None, len(names) - len(empty) - len(ids))]
    return cleaned, df.sparkSession.createDataFrame(steps, "step string, detail string, n bigint")


def threshold_flags(
    df: DataFrame, limits: Mapping[str, tuple[str, float]], any_name: str | None = None
) -> DataFrame:
    """Adds 0/1 columns `name -> (column, at least)`, and their OR under `any_name`."""
    flags = {name: (col(c) >= limit).cast("int") for name, (c, limit) in limits.items()}
    result = df.select("*", *[F.coalesce(e, F.lit(0)).alias(n) for n, e in flags.items()])
    if any_name:
        result = result.withColumn(any_name, F.greatest(F.lit(0), *[col(n) for n in flags]))
    return result
