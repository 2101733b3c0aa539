"""Households: roll-up of members, one household per client, household type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.missing import all_flag, any_flag, down, largest, smallest, up, within
from ..functions.rules import first_match
from .keyed import attach, first_per_key, weighted_left_join


def household_members(clients: DataFrame, memberships: DataFrame) -> DataFrame:
    """Clients with every household they belong to, and the measures of the household.

    ``clients``: client_id, gender, age_at_year_end; ``memberships``: client_id,
    household_id, relationship (recoded). Clients without a membership share the
    missing household. ``copies`` counts identical client rows; sizes count them all.
    """
    members = weighted_left_join(
        clients.select("client_id", "gender", "age_at_year_end"), memberships, ["client_id"]
    )
    relationship = F.col("relationship")
    return attach(
        members,
        ["household_id"],
        shared=True,
        household_size=F.sum("copies"),
        max_household_age=largest("age_at_year_end"),
        min_household_age=smallest("age_at_year_end"),
        self_partner_only=all_flag(within(relationship, ["Self", "Partner"])),
        has_child=any_flag(relationship == "Child"),
        has_parent=any_flag(relationship == "Parent"),
        all_heads=all_flag(relationship == "Self"),
        spans_generations=any_flag(within(relationship, ["Grandchild", "Grandparent"])),
        has_other_family=any_flag(within(relationship, ["Sibling", "Other Relative"])),
    )


def largest_household(members: DataFrame) -> DataFrame:
    """One row per client: its largest household, measured before the assignment.

    Ties go to the smallest household id, then to the remaining columns in order.
    """
    order = [
        down("household_size"),
        up("household_id"),
        up("relationship"),
        up("gender"),
        up("age_at_year_end"),
    ]
    return first_per_key(members, ["client_id"], order).drop("age_at_year_end", "copies")


def household_type(unknown_age: str = "infinite") -> Column:
    """Type of a household from its measures and the gender of the row's client.

    With ``infinite`` a household without any known age counts as adults, as in the
    source reports; ``null`` makes the two rules for unknown ages apply instead.
    A missing gender decides rule four at any household size.
    """
    youngest = F.col("min_household_age")
    if unknown_age == "infinite":
        youngest = F.coalesce(youngest.cast("double"), F.lit(float("inf")))
    single = F.col("household_size") == 1
    gender = F.col("gender")
    descent = (
        (F.col("has_child") == 1) | (F.col("has_parent") == 1) | (F.col("spans_generations") == 1)
    )
    conditions = [
        youngest < 18,
        single & within(gender, [L.TRANS_WOMAN, L.FEMALE]),
        single & within(gender, [L.TRANS_MAN, L.MALE]),
        (single & within(gender, L.GENDER_UNKNOWN)) | gender.isNull(),
        single & (gender == L.NON_BINARY),
        F.col("self_partner_only") == 1,
        (youngest >= 18) & descent,
        youngest.isNull() & descent,
        F.col("has_other_family") == 1,
        youngest >= 18,
    ]
    return first_match(zip(conditions, L.HOUSEHOLD_TYPES), otherwise=L.HOUSEHOLD_TYPES[-1])
