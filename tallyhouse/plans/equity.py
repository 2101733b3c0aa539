"""Equity evaluator: a target group against all others, over any numeric factors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recode
from ..functions.missing import as_column
from ..operators import compare, distributions, reshape
from ..sources.sheets import assessment_table


@dataclass(frozen=True)
class Comparison:
    """A two-group table (group, factors) with its labels and factors."""

    rows: DataFrame
    groups: tuple[str, str]
    factors: tuple[str, ...]

    def averages(self) -> DataFrame:
        return compare.averages_table(self.rows, "group", self.factors, self.groups)

    def tests(self) -> DataFrame:
        return compare.tukey_tests(self.rows, "group", self.factors, self.groups)

    def bands(self) -> DataFrame:
        return compare.significance_bands(self.tests())

    def distributions(self) -> DataFrame:
        return distributions.distribution_rows(self.rows, self.factors)

    def medians(self, *, approximate: bool = False) -> DataFrame:
        """Quartiles of the scaled factors: taken of the raw values, then scaled."""
        rows = distributions.quartile_table(self._long(), self.groups, approximate=approximate)
        parts = ("q1", "median", "q3")
        return self._scaled(rows, parts).select("group", "variable", *parts)

    def densities(self, points: int = 512) -> DataFrame:
        """Densities of the scaled factors, from those of the raw values."""
        rows = distributions.density(self._long(), self.groups, points=points, with_range=True)
        scaled = self._scaled(rows, ["x"]).withColumn("density", F.col("density") * F.col("span"))
        return scaled.drop("least", "span", "low", "high")

    def _long(self) -> DataFrame:
        return reshape.to_long(self.rows, "group", self.factors)

    def _scaled(self, table: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Values on the scale of their factor. The groups cover all rows, so their ranges give the factor's."""
        factor = Window.partitionBy("variable")
        least = F.min("low").over(factor)
        ranged = table.withColumns({"least": least, "span": F.max("high").over(factor) - least}).filter("span > 0")
        return ranged.withColumns({c: (F.col(c) - F.col("least")) / F.col("span") for c in columns})


def choices(table: DataFrame, split: str) -> DataFrame:
    """Groups that can be chosen as target."""
    return table.select(as_column(split)).distinct()


def comparison(
    uploaded: DataFrame,
    targets: Sequence[str],
    split: str | None = None,
    factors: Sequence[str] | None = None,
) -> Comparison:
    """Comparison over an uploaded table; by default all factors, split by race."""
    table = assessment_table(uploaded)
    split = split or reshape.default_grouping(table)
    factors = tuple(factors or reshape.numeric_columns(table))
    rows = compare.comparison_table(table, split, targets, factors)
    return Comparison(rows, (recode.target_label(targets), "Other"), factors)
