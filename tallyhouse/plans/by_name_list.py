"""By-name-list report: who was on the list in a year, in which households."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import recode
from ..functions.dates import completed_years, day
from ..functions.missing import up, within
from ..functions.rules import rank_of
from ..operators.households import household_members, household_type, largest_household
from ..operators.keyed import join_on
from ..operators.metrics import Metric, distinct_counts, distinct_pairs_per, rows_per

NAME = "by_name_list"


def list_members(clients: DataFrame, start: str, end: str) -> DataFrame:
    """Clients on the list in the report year (``yyyymmdd`` bounds), recoded, with their age."""
    on_list = recode.on_active_list(
        "newly_homeless", "client_status", "status_date", day(start), day(end)
    )
    return clients.filter(on_list).withColumns(
        {
            "age_at_year_end": completed_years("birth_date", day(end)),
            "census_race": recode.census_race("census_race"),
            "gender": recode.gender("gender"),
        }
    )


def cleaned_memberships(memberships: DataFrame) -> DataFrame:
    return memberships.select(
        "client_id", "household_id", recode.relationship("relationship").alias("relationship")
    )


def assigned_households(members: DataFrame, memberships: DataFrame) -> DataFrame:
    """One row per client with its household and the household's measures."""
    return largest_household(household_members(members, cleaned_memberships(memberships)))


def roster(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """List rows with the household of their client."""
    households = assigned.select(
        "client_id", "household_id", "household_size", "max_household_age", "min_household_age"
    )
    return join_on(members, households, ["client_id"])


def _is_bipoc():
    return recode.bipoc(["census_race"], "ethnicity", "census") == 1


def system_map_metrics() -> list[Metric]:
    household, client = "household_id", "client_id"
    everyone = F.lit(True)
    return [
        Metric("Total households", household, everyone),
        Metric("Families", household, F.col("min_household_age") < 18),
        Metric("Veterans", client, F.col("veteran") == "Yes"),
        Metric("Youth households", household, F.col("max_household_age").between(18, 24)),
        Metric("Seniors 55+", client, F.col("age_at_year_end") >= 55),
        Metric("BIPOC Households", household, _is_bipoc() & (F.col("age_at_year_end") >= 18)),
    ]


def client_metrics() -> list[Metric]:
    client = "client_id"
    return [
        Metric("All people", client, F.lit(True)),
        Metric("Children", client, F.col("age_at_year_end") < 18),
        Metric("BIPOC", client, _is_bipoc()),
        Metric("Women + NB", client, within("gender", L.WOMEN_AND_NON_BINARY)),
        Metric("Newly Homeless", client, F.col("newly_homeless").isNotNull()),
        Metric("Latinx", client, within("ethnicity", [L.HISPANIC_OLD, L.HISPANIC])),
    ]


def family_metrics() -> list[Metric]:
    family = F.col("min_household_age") < 18
    newly = F.col("newly_homeless").isNotNull()
    return [
        Metric("People in families", "client_id", family),
        Metric("Newly homeless in families", "client_id", family & newly),
        Metric("Families with newly homeless", "household_id", family & newly),
        Metric(
            "Families with newly homeless adult",
            "household_id",
            family & newly & (F.col("age_at_year_end") >= 18),
        ),
    ]


def system_map(roster_rows: DataFrame) -> DataFrame:
    return distinct_counts(roster_rows, system_map_metrics())


def client_counts(members: DataFrame) -> DataFrame:
    return distinct_counts(members, client_metrics())


def family_follow_ups(roster_rows: DataFrame) -> DataFrame:
    return distinct_counts(roster_rows, family_metrics())


def typed_households(assigned: DataFrame, unknown_age: str = "infinite") -> DataFrame:
    return assigned.withColumn("household_type", household_type(unknown_age))


def household_type_table(assigned: DataFrame) -> DataFrame:
    """Households of each type; one household can count under two types."""
    return distinct_pairs_per(
        typed_households(assigned), "household_id", "household_type", name="households"
    )


def age_table(members: DataFrame) -> DataFrame:
    """List rows per age bucket, in bucket order."""
    bucketed = members.select(recode.age_bucket("age_at_year_end").alias("age_bucket"))
    return rows_per(bucketed, "age_bucket", name="people").orderBy(rank_of("age_bucket", L.AGE_LEVELS))


def race_table(members: DataFrame) -> DataFrame:
    """List rows per race level, in level order; everything else is the missing level."""
    levels = members.select(recode.race_level("census_race", "ethnicity").alias("race"))
    return rows_per(levels, "race", name="people").orderBy(up(rank_of("race", L.RACE_LEVELS)))


def gender_table(members: DataFrame) -> DataFrame:
    return rows_per(members, "gender", name="people").orderBy(up("gender"))


def bipoc_ethnicity_table(members: DataFrame) -> DataFrame:
    """Adult BIPOC list rows per ethnicity.

    The household is unique per client, so looking it up would not change the rows.
    """
    adults = members.filter(_is_bipoc() & (F.col("age_at_year_end") >= 18))
    return rows_per(adults, "ethnicity", name="households").orderBy(up("ethnicity"))


def unmapped_relationships(memberships: DataFrame) -> DataFrame:
    """Check: relationship values that no rule covers."""
    values = cleaned_memberships(memberships).select("relationship").distinct()
    return values.filter(~within("relationship", recode.known_relationships()))


def undetermined_households(assigned: DataFrame, unknown_age: str = "infinite") -> DataFrame:
    """Check: clients whose household could not be typed, by household.

    The order runs over the whole table, so ask for it only where a reader needs it.
    """
    typed = typed_households(assigned, unknown_age)
    return typed.filter(F.col("household_type") == L.HOUSEHOLD_TYPES[-1]).orderBy(
        up("household_id"), up("client_id")
    )


def report(clients: DataFrame, memberships: DataFrame, start: str, end: str) -> DataFrame:
    """All labelled metrics of the report, from one pass over the roster."""
    members = list_members(clients, start, end)
    rows = roster(members, assigned_households(members, memberships))
    metrics = [*system_map_metrics(), *client_metrics(), *family_metrics()]
    return distinct_counts(rows, metrics).select(F.lit(NAME).alias("report"), "*")
