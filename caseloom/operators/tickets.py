"""Support-ticket preparation: dates, SLA hours, text features, targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from caseloom.functions.columns import TEXT_SCORE, col, normalise_names, number
from caseloom.functions.values import hours_between, negativity, parse_number, parse_timestamp
from caseloom.operators.cleaning import fill_numeric
from caseloom.operators.encoding import categories
from caseloom.operators.quantiles import exact_medians
from caseloom.operators.tfidf import MAX_TERMS, Vocabulary, add_tfidf, fit_vocabulary
from caseloom.session import cut_lineage

# The ticket columns by use ("remedy targeet" is spelled so in the data).
ID_AND_CONTACT = ("case number", "contact name")
DATE_COLUMNS = ("date open", "call back target", "remedy targeet", "solution target")
TEXT_COLUMNS = ("subject", "desc", "answer")
HOUR_COLUMNS = (
    "hours_open", "target_callback_hours", "target_solution_hours", "resolution_hours", "resolution_time",
    "target_callback_time",
)
TARGETS = {"resolution": "resolution_hours", "priority": "priority", "owner": "case owner"}


def parse_dates(df: DataFrame, day_first: bool = False) -> DataFrame:
    """The ticket date columns as TIMESTAMP_NTZ; what does not parse is NULL."""
    def parsed(f: T.StructField) -> Column:
        if f.name not in DATE_COLUMNS or isinstance(f.dataType, T.TimestampNTZType):
            return col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.DateType)):
            return col(f.name).cast("timestamp_ntz").alias(f.name)
        return parse_timestamp(col(f.name), day_first).alias(f.name)

    return df.select(*[parsed(f) for f in df.schema])


def reference_date(df: DataFrame) -> Column:
    """Latest opening date as a scalar subquery: one extra scan of one column, no join."""
    return df.agg(F.max(col("date open")).alias("ref")).scalar()


def add_sla_hours(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Adds target_solution_hours, target_callback_hours and hours_open where their dates exist.

    hours_open runs to `as_of`, by default the latest opening date of the table, and is never negative.
    """
    if "date open" not in df.columns:
        return df
    opened = col("date open")
    added = {}
    if "solution target" in df.columns:
        added["target_solution_hours"] = hours_between(opened, col("solution target"))
    if "call back target" in df.columns:
        added["target_callback_hours"] = hours_between(opened, col("call back target"))
    until = reference_date(df) if as_of is None else as_of
    waiting = hours_between(opened, until)
    added["hours_open"] = F.when(waiting.isNotNull(), F.greatest(waiting, F.lit(0.0)))
    return df.select("*", *[e.alias(n) for n, e in added.items()])


def add_resolution_hours(df: DataFrame) -> DataFrame:
    if not {"date open", "solution target"}.issubset(df.columns):
        return df
    return df.withColumn("resolution_hours", hours_between(col("date open"), col("solution target")))


def dirty_number_columns(df: DataFrame, but: str | None = None) -> list[str]:
    """Columns that must be numeric: the hour columns, product flags and TF-IDF weights."""
    return [
        c for c in df.columns
        if c != but and (c in HOUR_COLUMNS or c.startswith("prod_") or c.startswith("tfidf_"))
    ]


def as_numbers(df: DataFrame, target: str | None = None) -> DataFrame:
    """Dirty numeric columns (but not the target) as doubles; what does not parse is NULL."""
    names = set(dirty_number_columns(df, but=target))
    kinds = dict(df.dtypes)
    return df.select(*[
        (parse_number(col(c)) if kinds[c] == "string" else number(c)).alias(c)
        if c in names and (df.schema[c].nullable or kinds[c] == "string") else col(c)
        for c in df.columns
    ])


def clean_numbers(df: DataFrame, target: str | None = None) -> DataFrame:
    """Dirty numeric columns as doubles, gaps filled with the median (0 without any value).

    The target is left as it is, so a row without target is not given a made-up one.
    """
    numbers = as_numbers(df, target)
    may_lack = [c for c in dirty_number_columns(df, but=target) if numbers.schema[c].nullable]
    medians = exact_medians(numbers, may_lack)
    return fill_numeric(numbers, {c: m or 0.0 for c, m in medians.items()})


def ticket_text(df: DataFrame) -> Column:
    """Lower-case subject and description of a ticket."""
    return F.lower(F.concat_ws(" ", *[
        F.coalesce(col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in ("subject", "desc")
    ]))


def add_negativity(df: DataFrame, text: Column | None = None) -> DataFrame:
    return df.withColumn(TEXT_SCORE, negativity(ticket_text(df) if text is None else text))


def feature_drop_list(df: DataFrame, task: str) -> list[str]:
    """Columns that must not become features of a task."""
    target = TARGETS[task]
    drop = {*ID_AND_CONTACT, *DATE_COLUMNS, *TEXT_COLUMNS, "status", "product"}
    if task == "resolution":
        drop |= {"priority", "target_solution_hours"}
    return [c for c in df.columns if c in drop and c != target]


@dataclass(frozen=True)
class TicketRecipe:
    """What was learned from the training tickets and is needed to prepare new ones alike."""

    task: str
    products: tuple[str, ...]
    vocabulary: Vocabulary
    as_of: str | None

    @property
    def target(self) -> str:
        return TARGETS[self.task]


def fit_recipe(df: DataFrame, task: str, max_terms: int = MAX_TERMS, max_categories: int | None = None) -> TicketRecipe:
    """Learn products, text vocabulary and reference date from (training) tickets with parsed dates."""
    if task not in TARGETS:
        raise ValueError(f"task must be one of {sorted(TARGETS)}, not {task!r}")
    products = categories(df, ["product"], max_categories)["product"] if "product" in df.columns else []
    as_of = df.agg(F.max(col("date open")).cast("string")).first()[0] if "date open" in df.columns else None
    return TicketRecipe(task, tuple(products), fit_vocabulary(df, ticket_text(df), max_terms), as_of)


def apply_recipe(df: DataFrame, recipe: TicketRecipe) -> DataFrame:
    """Features (and the target, where its sources exist) of tickets; a projection without a shuffle."""
    as_of = F.lit(recipe.as_of).cast("timestamp_ntz") if recipe.as_of else F.lit(None).cast("timestamp_ntz")
    out = add_tfidf(add_negativity(add_sla_hours(df, as_of)), ticket_text(df), recipe.vocabulary)
    if recipe.products:
        product = col("product") if "product" in df.columns else F.lit(None).cast("string")
        out = out.select("*", *[
            F.coalesce((product == p).cast("int"), F.lit(0)).alias(f"prod_{p}") for p in recipe.products
        ])
    if recipe.task == "resolution":
        out = add_resolution_hours(out)
    return out.drop(*feature_drop_list(out, recipe.task))


def prepare_tickets(df: DataFrame, task: str, day_first: bool = False) -> tuple[DataFrame, str, TicketRecipe]:
    """(features and target, target column, recipe) for one of resolution, priority, owner."""
    if task not in TARGETS:
        raise ValueError(f"task must be one of {sorted(TARGETS)}, not {task!r}")
    tickets = cut_lineage(parse_dates(normalise_names(df), day_first))
    recipe = fit_recipe(tickets, task)
    out = apply_recipe(tickets, recipe)
    if recipe.target not in out.columns:
        raise ValueError(f"column {recipe.target!r} is missing and cannot be derived")
    return clean_numbers(out, recipe.target), recipe.target, recipe

