"""Wide and long forms, column selection, facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import as_column


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def default_grouping(df: DataFrame) -> str | None:
    """First non-numeric column that names race, else the first non-numeric one."""
    choices = other_columns(df)
    return next((c for c in choices if "race" in c.lower()), choices[0] if choices else None)


def key_first(df: DataFrame, key: str) -> DataFrame:
    """Key column, then the others in alphabetical order."""
    return df.select(*map(as_column, [key, *sorted(c for c in df.columns if c != key)]))


def to_long(df: DataFrame, group: str, factors: Sequence[str]) -> DataFrame:
    """Rows ``(group, variable, value)``, one per factor, values as double."""
    doubles = [as_column(f).cast("double").alias(f) for f in factors]
    wide = df.select(as_column(group), *doubles)
    return wide.unpivot([as_column(group)], [as_column(f) for f in factors], "variable", "value")


def to_wide(long: DataFrame, group: str, factors: Sequence[str], value: str = "value") -> DataFrame:
    """One row per group, one column per factor."""
    return long.groupBy(group).pivot("variable", list(factors)).agg(F.first(value))


def facet(df: DataFrame, number: str, low, high, category: str, selected: Sequence) -> DataFrame:
    """Rows in a closed numeric range whose category is one of the selected ones."""
    return df.filter(as_column(number).between(low, high) & as_column(category).isin(list(selected)))


def facet_choices(df: DataFrame, number: str, low, high, category: str) -> DataFrame:
    """Categories that occur inside the range."""
    return df.filter(as_column(number).between(low, high)).select(as_column(category)).distinct()


def scaled(df: DataFrame, factors: Sequence[str], *, strict: bool) -> DataFrame:
    """Factors scaled to [0, 1] over the whole table; a constant factor becomes missing.

    ``strict`` voids a factor with any missing value, otherwise those rows stay missing.
    The bounds are one aggregated row, read as a scalar subquery.
    """
    bounds = df.agg(F.struct(*_bounds(factors)).alias("bounds")).scalar()

    def scale(i: int, f: str) -> Column:
        low, high = bounds[f"{i}_min"], bounds[f"{i}_max"]
        share = F.try_divide(as_column(f).cast("double") - low, high - low)
        return F.when(bounds[f"{i}_full"], share) if strict else share

    return df.withColumns({f: scale(i, f) for i, f in enumerate(factors)})


def factor_bounds(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """One row per factor: variable, its smallest value, its span, whether none is missing.

    Factors without a span are left out. The number of factors bounds the table.
    """
    entries = [
        F.struct(
            F.lit(f).alias("variable"),
            F.col(f"{i}_min").alias("least"),
            (F.col(f"{i}_max") - F.col(f"{i}_min")).alias("span"),
            F.col(f"{i}_full").alias("complete"),
        )
        for i, f in enumerate(factors)
    ]
    return df.agg(*_bounds(factors)).select(F.inline(F.array(*entries))).filter("span > 0")


def scaled_long(df: DataFrame, group: str, factors: Sequence[str], *, strict: bool) -> DataFrame:
    """The scaled factors in long form, missing values left out."""
    bounds = factor_bounds(df, factors)
    if strict:
        bounds = bounds.filter("complete")
    rows = to_long(df, group, factors).dropna(subset=["value"])
    share = (F.col("value") - F.col("least")) / F.col("span")
    joined = rows.join(F.broadcast(bounds), "variable")
    return joined.select(as_column(group), "variable", share.alias("value"))


def _bounds(factors: Sequence[str]) -> list[Column]:
    """Aggregates: smallest and largest value of each factor, and whether none is missing."""
    aggregates = []
    for i, c in enumerate(map(as_column, factors)):
        aggregates += [
            F.min(c).cast("double").alias(f"{i}_min"),
            F.max(c).cast("double").alias(f"{i}_max"),
            (F.count(c) == F.count(F.lit(1))).alias(f"{i}_full"),
        ]
    return aggregates
