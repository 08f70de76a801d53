"""Schema predicates, column-name resolution and role mapping.  No job runs here."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

TEXT_SCORE = "text_negativity_score"
TFIDF_PREFIX = "tfidf_"
PRODUCT_PREFIX = "prod_"

# The columns that mark a table as support tickets.
TICKET_SIGNATURE = ("priority", "case owner", "solution target")

# Case roles, whether they are required, and the name parts that suggest them.
ROLE_HINTS: dict[str, tuple[bool, tuple[str, ...]]] = {
    "caseNumber": (True, ("case number", "caseid", "case id", "id")),
    "subject": (True, ("subject", "title")),
    "contactName": (False, ("contact name", "customer", "requester")),
    "status": (True, ("status",)),
    "dateOpen": (True, ("date open", "opened", "created")),
    "caseOwner": (False, ("case owner", "owner", "assigned")),
    "remedyTarget": (True, ("remedy target", "resolution target", "solution target")),
}


def col(name: str) -> Column:
    """Column by literal name, also with dots, spaces or backticks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType, booleans: bool = False) -> bool:
    return isinstance(dtype, T.NumericType) or (booleans and isinstance(dtype, T.BooleanType))


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame, booleans: bool = False, but: Iterable[str] = ()) -> list[str]:
    skip = set(but)
    return [f.name for f in df.schema if is_numeric(f.dataType, booleans) and f.name not in skip]


def text_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    skip = set(but)
    return [f.name for f in df.schema if is_text(f.dataType) and f.name not in skip]


def finite(name: str, dtype: T.DataType) -> Column:
    """The column with NaN and infinities as NULL; other types unchanged."""
    value = col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        return F.when(~bad, value).alias(name)
    return value.alias(name)


def number(name: str) -> Column:
    """The column as a double, with NaN as NULL."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def finite_number(name: str) -> Column:
    """The column as a double, with NaN and infinities as NULL."""
    value = number(name)
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def resolve_column(df: DataFrame, name: str) -> str:
    """Exact column name, else the first that is equal after trimming."""
    if name in df.columns:
        return name
    for candidate in df.columns:
        if candidate.strip() == name.strip():
            return candidate
    raise ValueError(f"no column named {name!r}; available: {df.columns}")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s) {missing}; available: {df.columns}")


def normalise_names(df: DataFrame) -> DataFrame:
    """Trim and lower-case all column names; two names that become equal are an error."""
    names = [c.strip().lower() for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after trimming and lower-casing: {clashes}")
    return df.toDF(*names)


def guess_roles(columns: Iterable[str]) -> dict[str, str | None]:
    """For each case role the first column whose name holds one of its hints."""
    names = list(columns)
    flat = {c: re.sub(r"[_\s]+", " ", c.lower()) for c in names}
    return {
        role: next((c for c in names if any(h in flat[c] for h in hints)), None)
        for role, (_, hints) in ROLE_HINTS.items()
    }


def missing_roles(mapping: Mapping[str, str | None]) -> list[str]:
    return [role for role, (required, _) in ROLE_HINTS.items() if required and not mapping.get(role)]


def map_roles(df: DataFrame, mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """Project the mapped source columns under their role names."""
    mapping = dict(mapping or guess_roles(df.columns))
    absent = missing_roles(mapping)
    if absent:
        raise ValueError(f"no column for required role(s) {absent}")
    return df.select(*[col(source).alias(role) for role, source in mapping.items() if source])


def is_ticket_table(df: DataFrame) -> bool:
    names = {c.strip().lower() for c in df.columns}
    return names.issuperset(TICKET_SIGNATURE)


def split_text_derived(columns: Iterable[str]) -> tuple[list[str], list[str]]:
    """(plain, text-derived) column names."""
    names = list(columns)
    derived = [c for c in names if c.startswith(TFIDF_PREFIX) or c == TEXT_SCORE]
    return [c for c in names if c not in derived], derived
