"""Hotline report: households and clients calling, by population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators.identity import (
    classified_callpoint,
    classified_calls,
    single_sheet_base,
    summary_base_of_calls,
    unified_calls,
)
from ..operators.metrics import Metric, distinct_counts, rows_per
from ..sources.schemas import TEST_CLIENTS
from ..sources.sheets import without_records

NAME = "hotline"
EVERYONE = "All Calling"


def all_calls(
    calls: DataFrame,
    situations: DataFrame,
    demographics: DataFrame,
    callpoint: DataFrame,
    variant: str = "v3",
) -> DataFrame:
    """Classified calls of all sources. ``v2`` leaves the second call source out."""
    own = classified_calls(
        without_records(calls, "client_id", TEST_CLIENTS), situations, demographics, variant
    )
    if variant == "v2":
        return own
    named = without_records(callpoint, "client_id", TEST_CLIENTS).dropna(subset=["name_string"])
    return unified_calls(own, classified_callpoint(named, variant))


def call_metrics(populations: bool = True, bipoc: bool = True) -> list[Metric]:
    shelter = F.col("asked_shelter") == "Yes"
    base = [
        ("All households", "household_id", F.lit(True)),
        ("Families", "household_id", F.col("min_age") < 18),
        ("Veterans", "client_id", F.col("veteran") == "Yes"),
        ("Youth households", "household_id", F.col("max_age").between(18, 24)),
        ("Seniors", "client_id", F.col("age") >= 55),
    ]
    if bipoc:
        adult = (F.col("max_age") >= 18) | F.col("max_age").isNull()
        base.append(("BIPOC households", "household_id", adult & (F.col("bipoc") == 1)))
    groups = {EVERYONE: F.lit(True)}
    if populations:
        groups["Literally Homeless Calling"] = F.col("housed_status") == L.LITERALLY
        groups["Not Homeless/Unknown Calling"] = F.col("housed_status") != L.LITERALLY
    return [
        Metric(name, key, group & where & extra, title)
        for title, group in groups.items()
        for label, key, where in base
        for name, extra in ((f"{label} calling", F.lit(True)), (f"{label} calling for shelter", shelter))
    ]


def hotline_counts(base: DataFrame) -> DataFrame:
    """Twelve metrics for three populations over a summary base."""
    return distinct_counts(base, call_metrics())


def report(
    calls: DataFrame,
    situations: DataFrame,
    demographics: DataFrame,
    callpoint: DataFrame,
    variant: str = "v3",
) -> DataFrame:
    merged = all_calls(calls, situations, demographics, callpoint, variant)
    return hotline_counts(summary_base_of_calls(merged, variant)).select(F.lit(NAME).alias("report"), "*")


def single_sheet_report(calls: DataFrame) -> DataFrame:
    """The one-sheet report: ten metrics over all callers."""
    counts = distinct_counts(single_sheet_base(calls), call_metrics(populations=False, bipoc=False))
    return counts.select(F.lit(NAME).alias("report"), "*")


def people_per_status(resolved: DataFrame) -> DataFrame:
    """Check: distinct persons under each housing status."""
    people = resolved.select("name_string", "birth_date", "housed_status").distinct()
    return rows_per(people, "housed_status", name="people")
