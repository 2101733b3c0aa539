"""Significance report: White against BIPOC, one Welch test per numeric factor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import compare, distributions, reshape

GROUPS = ("BIPOC", "White")
# Tests compare the two groups; tables and charts show rows of unknown group beside them.
SHOWN = (*GROUPS, None)


def tests(
    assessments: DataFrame, *, normalised: bool = False, p_digits: int | None = None
) -> DataFrame:
    """Tests over every numeric column; ``normalised`` scales them first, which voids
    factors with missing values. ``p_digits=3`` prints p as the source report does."""
    rows = compare.equity_groups(assessments)
    factors = reshape.numeric_columns(assessments)
    if normalised:
        rows = reshape.scaled(rows, factors, strict=True)
    return compare.welch_tests(rows, "group", factors, GROUPS, p_digits=p_digits)


def long_rows(assessments: DataFrame, *, normalised: bool = False) -> DataFrame:
    rows = compare.equity_groups(assessments)
    factors = reshape.numeric_columns(assessments)
    if normalised:
        return distributions.distribution_rows(rows, factors, strict=True)
    return reshape.to_long(rows, "group", factors)


def boxes(assessments: DataFrame, *, normalised: bool = False) -> DataFrame:
    return distributions.box_table(long_rows(assessments, normalised=normalised), SHOWN)


def histogram(assessments: DataFrame, factor: str) -> DataFrame:
    return distributions.histogram(compare.equity_groups(assessments), "group", factor)


def ridges(assessments: DataFrame, factor: str, points: int = 512) -> DataFrame:
    """Density of one factor per group, reaching three bandwidths beyond the data, with
    a joint bandwidth."""
    long = _one_factor(assessments, factor)
    return distributions.density(long, SHOWN, points=points, cut=3.0, shared=True)


def ridge_medians(assessments: DataFrame, factor: str) -> DataFrame:
    """The line drawn into each ridge."""
    rows = distributions.quartile_table(_one_factor(assessments, factor), SHOWN)
    return rows.select("group", "variable", "median")


def _one_factor(assessments: DataFrame, factor: str) -> DataFrame:
    return reshape.to_long(compare.equity_groups(assessments), "group", [factor])
