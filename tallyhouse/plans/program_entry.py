"""Program entry report: system map by population, program summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import recode
from ..functions.dates import day, in_window
from ..functions.missing import down, holds, largest, smallest, up
from ..operators.keyed import attach, first_per_key, join_on
from ..operators.metrics import Metric, distinct_counts, distinct_pairs_per

NAME = "program_entry"
HOUSING_ENTRY = "Entered TH/RRH/PSH program"
# Columns a metric is decided by; the populations need none of them.
DECIDING = ("program_type", "entry_ts", "exit_date", "exit_destination")


def scored_demographics(demographics: DataFrame) -> DataFrame:
    """One row per client: the best-scored one; ties go to the smallest tie key."""
    return first_per_key(demographics, ["client_id"], [down("score"), up("tie_key")])


def _ages() -> dict[str, Column]:
    """Highest and lowest age per entry group, missing when any member's age is."""
    return {
        "max_entry_age": largest("age_at_entry", "propagate"),
        "min_entry_age": smallest("age_at_entry", "propagate"),
    }


def group_ages(entries: DataFrame) -> DataFrame:
    return entries.groupBy("group_uid").agg(*[c.alias(name) for name, c in _ages().items()])


def with_group_ages(entries: DataFrame) -> DataFrame:
    return attach(entries, ["group_uid"], shared=True, **_ages())


def _conditions(start: str, end: str) -> dict[str, Column]:
    program = F.col("program_type")
    entered = in_window("entry_ts", day(start), day(end))
    left = in_window("exit_date", day(start), day(end)) & (F.col("exit_destination") == L.PERMANENT)
    return {
        "Entered shelter": (program == L.EMERGENCY_SHELTER) & entered,
        "Entered diversion": (program == L.DIVERSION) & entered,
        "Housed through diversion": (program == L.DIVERSION) & left,
        "Were open in CE": program == L.COORDINATED_ENTRY,
        HOUSING_ENTRY: program.isin(list(L.HOUSING_PROGRAMS)) & entered,
        "Stabilized through prevention": (program == L.PREVENTION) & left,
    }


def counted_stays(entries: DataFrame, start: str, end: str) -> DataFrame:
    """Stays that some metric counts, with one boolean column per metric in place of the
    columns it is decided by, so that little is shuffled and each test runs once."""
    flags = {f"stay{i}": holds(c) for i, c in enumerate(_conditions(start, end).values())}
    rest = [c for c in entries.columns if c not in DECIDING]
    return entries.withColumns(flags).select(*rest, *flags).filter(" OR ".join(flags))


def system_map_counts(
    rows: DataFrame, populations: dict[str, tuple[str, Column]], start: str, end: str
) -> DataFrame:
    """Six metrics for each population, given as title → (key column, condition)."""
    return _count(counted_stays(rows, start, end), populations, list(_conditions(start, end)))


def _count(
    stays: DataFrame,
    populations: dict[str, tuple[str, Column]],
    names: list[str],
    more: Sequence[Metric] = (),
) -> DataFrame:
    members = {f"member{i}": member for i, (_, member) in enumerate(populations.values())}
    metrics = [
        Metric(name, key, F.col(f"member{i}") & F.col(f"stay{j}"), title)
        for i, (title, (key, _)) in enumerate(populations.items())
        for j, name in enumerate(names)
    ]
    return distinct_counts(stays.withColumns(members), [*metrics, *more])


def report_populations() -> dict[str, tuple[str, Column]]:
    household, client = "household_key", "client_id"
    age = F.col("age_at_entry")
    return {
        "All Households": (household, F.lit(True)),
        "Families With Children": (household, F.col("min_entry_age") < 18),
        "Veterans": (client, F.col("is_veteran")),
        "Youth Households": (household, F.col("max_entry_age").between(18, 24)),
        "Seniors 55+": (client, age >= 55),
        "BIPOC Households": (household, (age >= 18) & F.col("is_bipoc")),
    }


def _mapped_stays(entries: DataFrame, demographics: DataFrame, start: str, end: str) -> DataFrame:
    """Counted stays with the ages of their group and the flags of their client.

    Stays that no metric counts are dropped before the joins; the ages of their
    group still see all its stays.
    """
    people = scored_demographics(demographics).select(
        "client_id",
        (F.col("veteran_status") == L.VETERAN_YES).alias("is_veteran"),
        (recode.bipoc(["primary_race", "secondary_race"], "ethnicity") == 1).alias("is_bipoc"),
    )
    stays = join_on(counted_stays(entries, start, end), group_ages(entries), ["group_uid"])
    return join_on(stays, people, ["client_id"])


def system_map(entries: DataFrame, demographics: DataFrame, start: str, end: str) -> DataFrame:
    """The system map of all six populations in one pass over the entries."""
    stays = _mapped_stays(entries, demographics, start, end)
    return _count(stays, report_populations(), list(_conditions(start, end)))


def agencies(providers: DataFrame) -> DataFrame:
    return providers.select("agency", "provider_id").distinct()


def housing_entries(entries: DataFrame, providers: DataFrame, start: str, end: str) -> DataFrame:
    """Entries into housing programs in the year, with the agencies of the provider."""
    entered = entries.filter(_conditions(start, end)[HOUSING_ENTRY])
    return join_on(entered, agencies(providers), ["provider_id"])


def _summary_metrics(where: Column) -> list[Metric]:
    keys = {"Agencies": "agency", "Programs": "provider_id", "Households": "household_key"}
    return [Metric(name, key, where) for name, key in keys.items()]


def program_summary(entries: DataFrame, providers: DataFrame, start: str, end: str) -> DataFrame:
    """Agencies, programs and households among the housing entries of the year."""
    return distinct_counts(housing_entries(entries, providers, start, end), _summary_metrics(F.lit(True)))


def program_types(entries: DataFrame, providers: DataFrame, start: str, end: str) -> DataFrame:
    """Programs per program type among the housing entries of the year."""
    rows = housing_entries(entries, providers, start, end)
    return distinct_pairs_per(rows, "provider_id", "program_type", name="programs")


def report(
    entries: DataFrame, demographics: DataFrame, providers: DataFrame, start: str, end: str
) -> DataFrame:
    """System map and program summary in one pass: the summary counts among the stays of the map.

    A provider of several agencies repeats its stays, which changes no distinct count.
    """
    names = list(_conditions(start, end))
    stays = join_on(_mapped_stays(entries, demographics, start, end), agencies(providers), ["provider_id"])
    summary = _summary_metrics(F.col(f"stay{names.index(HOUSING_ENTRY)}"))
    return _count(stays, report_populations(), names, summary).select(F.lit(NAME).alias("report"), "*")
