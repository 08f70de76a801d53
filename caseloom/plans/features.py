"""The feature recipe learned from training rows and applied alike when scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import col, number, numeric_columns, text_columns
from caseloom.operators.encoding import categories, indexed
from caseloom.operators.quantiles import exact_medians
from caseloom.operators.selection import select_features
from caseloom.operators.transforms import VARIANTS, non_negative_columns
from caseloom.plans.models import RAW


@dataclass(frozen=True)
class FeatureRecipe:
    """Everything needed to turn a row into the model's inputs; applying it is one projection."""

    numeric: tuple[str, ...] = ()
    medians: Mapping[str, float] = field(default_factory=dict)
    categories: Mapping[str, Sequence[str]] = field(default_factory=dict)
    booleans: tuple[str, ...] = ()
    selected: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()

    @property
    def features(self) -> list[str]:
        """Selected numeric features, then flags, in model order."""
        return [*self.selected, *self.booleans, *[f"{c}_{v}" for c, vs in self.categories.items() for v in vs]]

    def numeric_value(self, name: str) -> Column:
        return F.coalesce(number(name), F.lit(float(self.medians.get(name, 0.0))))

    def expressions(self, names: Sequence[str], present: Sequence[str]) -> list[Column]:
        flags = {f"{c}_{v}": (c, v) for c, vs in self.categories.items() for v in vs}
        out = []
        for name in names:
            if name in self.numeric:
                value = self.numeric_value(name) if name in present else F.lit(0.0)
            elif name in self.booleans:
                value = F.coalesce(col(name).cast("double"), F.lit(0.0)) if name in present else F.lit(0.0)
            elif name in flags:
                c, v = flags[name]
                value = F.coalesce((col(c) == v).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)
            else:
                suffix = next(s for s in VARIANTS if name.endswith(s) and name.removesuffix(s) in self.numeric)
                base = name.removesuffix(suffix)
                value = VARIANTS[suffix](self.numeric_value(base)) if base in present else F.lit(0.0)
            out.append(value.alias(name))
        return out

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """`keep` columns plus the assembled feature vector: numbers, then one block of flags per text column.

        A value's flag is found by a hash look-up and a block is a sparse vector, so a text column may have any
        number of values; null, unknown values and absent columns set no flag.
        """
        values = self.expressions([*self.selected, *self.booleans], df.columns)
        rows, parts = df.withColumn("__numbers", array_to_vector(F.array(*values))) if values else df, ["__numbers"] if values else []
        for i, (name, known) in enumerate(self.categories.items()):
            if not known:
                continue
            place = f"__place{i}"
            rows = indexed(rows, name, known, place) if name in df.columns else rows.withColumn(place, F.lit(None).cast("int"))
            labels = [str(k) for k in range(len(known) + 1)]
            rows = rows.withColumn(place, F.coalesce(F.col(place), F.lit(len(known))).cast("double").alias(place, metadata={
                "ml_attr": {"type": "nominal", "vals": labels, "name": place}}))
            encoder = OneHotEncoder(inputCol=place, outputCol=f"__flags{i}", dropLast=True)
            rows = encoder.fit(rows.limit(0)).transform(rows)
            parts.append(f"__flags{i}")
        rows = VectorAssembler(inputCols=parts, outputCol="__raw").transform(rows)
        return rows.select(*[col(c) for c in keep], F.col("__raw").alias(RAW, metadata={}))


def fit_features(
    train: DataFrame, target: str, target_is_class: bool, max_categories: int | None = None, selection: str = "bins",
) -> FeatureRecipe:
    """Learn medians, categories, sqrt/log variants and the informative features, all from training rows.

    `selection` names the estimate of mutual information (see select_features).
    """
    numeric = numeric_columns(train, but=[target])
    booleans = [c for c, t in train.dtypes if t == "boolean" and c != target]
    medians = {c: m for c, m in exact_medians(train, numeric).items() if m is not None}
    numeric = [c for c in numeric if c in medians]
    base = FeatureRecipe(
        tuple(numeric), medians, categories(train, text_columns(train, but=[target]), max_categories), tuple(booleans)
    )
    positive = non_negative_columns(train.select(*[base.numeric_value(c).alias(c) for c in numeric]), numeric) if numeric else []
    names = [*numeric, *[f"{c}{s}" for c in positive for s in VARIANTS if f"{c}{s}" not in numeric]]
    table = train.select(col(target), *base.expressions(names, train.columns))
    kept, dropped = select_features(table, names, target, target_is_class, method=selection)
    return FeatureRecipe(base.numeric, medians, base.categories, base.booleans, tuple(kept), tuple(dropped))
