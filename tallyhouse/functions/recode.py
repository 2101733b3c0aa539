"""Domain recodes: raw labels to report categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L
from .dates import in_window
from .missing import ColumnLike, as_column, holds, strict_if, within
from .rules import contains_all, first_match, only_levels


def gender(c: ColumnLike) -> Column:
    """Report gender from free, possibly multi-valued text (case-sensitive)."""
    c = as_column(c)
    return first_match(
        [
            (contains_all(c, "Transgender", "Female"), L.TRANS_WOMAN),
            (contains_all(c, "Transgender", "Male"), L.TRANS_MAN),
            (c.contains("non-binary") | contains_all(c, "Female", "Male"), L.NON_BINARY),
        ],
        otherwise=c,
    )


def relationship(c: ColumnLike) -> Column:
    """Relationship to the head of household; codes outside the table stay as they are."""
    c = as_column(c)
    rules = [(c.isin(list(codes)), label) for label, codes in L.RELATIONSHIPS.items()]
    return first_match([*rules, (c.isNull(), L.UNKNOWN)], otherwise=c)


def known_relationships() -> tuple[str, ...]:
    return tuple(L.RELATIONSHIPS)


def census_race(c: ColumnLike) -> Column:
    """List race, with the multi-racial label in its census wording."""
    c = as_column(c)
    return strict_if(c == L.MULTI_RACIAL, L.TWO_OR_MORE, c)


def race_level(race: ColumnLike, ethnicity: ColumnLike) -> Column:
    """Race-table category; missing when not one of the table's levels."""
    race, ethnicity = as_column(race), as_column(ethnicity)
    split = strict_if(
        (race == L.WHITE) & (ethnicity != L.HISPANIC), L.WHITE_NON_HISPANIC, race
    )
    return only_levels(split, L.RACE_LEVELS)


def bipoc(
    races: Sequence[ColumnLike], ethnicity: ColumnLike, vocabulary: str = "current"
) -> Column:
    """0/1 flag over any number of race columns and the ethnicity; never missing.

    Vocabularies: ``current`` and ``old`` caller labels, ``census`` for the client list.
    """
    listed, hispanic = {
        "current": (L.BIPOC_RACES, (L.HISPANIC,)),
        "old": (L.BIPOC_RACES_OLD, (L.HISPANIC_OLD,)),
        "census": (L.BIPOC_CENSUS_RACES, (L.HISPANIC_OLD, L.HISPANIC)),
    }[vocabulary]
    hit = within(ethnicity, hispanic)
    for race in races:
        hit = hit | within(race, listed)
    return hit.cast("int")


def housing_status(
    code: ColumnLike,
    situation: ColumnLike,
    fleeing: ColumnLike | None = None,
    *,
    variant: str = "v3",
    source: str = "calls",
) -> Column:
    """Housing status of a call from its need code (or call type) and living situation.

    ``v2`` also reads the fleeing flag and, for the ``calls`` source, the "probable"
    codes, and leaves the rest unknown; ``v3`` counts the rest as not literally homeless.
    """
    code = as_column(code)
    literal = within(code, L.LITERAL_CODES) | within(situation, L.LITERAL_SITUATIONS)
    if variant == "v2":
        literal = literal | holds(as_column(fleeing) == "Yes")
    housed = within(code, L.HOUSED_CODES) | within(situation, L.HOUSED_SITUATIONS)
    rules = [(literal, L.LITERALLY), (housed, L.NOT_LITERALLY)]
    if source == "calls":
        if variant == "v2":
            rules.append((within(code, L.PROBABLY_LITERAL_CODES), L.LITERALLY))
        rules.append((within(code, L.PROBABLY_HOUSED_CODES), L.NOT_LITERALLY))
    return first_match(rules, otherwise=L.UNKNOWN if variant == "v2" else L.NOT_LITERALLY)


def situation_kind(situation: ColumnLike) -> Column:
    """A living situation reduced to one text per outcome it can lead to.

    Any situation that decides nothing becomes missing, so a client-day has at most
    three kinds however many situations were recorded for it.
    """
    return first_match(
        [
            (within(situation, L.LITERAL_SITUATIONS), L.LITERAL_SITUATIONS[0]),
            (within(situation, L.HOUSED_SITUATIONS), L.HOUSED_SITUATIONS[0]),
        ]
    )


def status_rank(status: ColumnLike) -> Column:
    status = as_column(status)
    return first_match([(status == L.LITERALLY, 2), (status == L.NOT_LITERALLY, 1)], 0)


def status_of_rank(rank: ColumnLike) -> Column:
    rank = as_column(rank)
    return first_match([(rank == 2, L.LITERALLY), (rank == 1, L.NOT_LITERALLY)], L.UNKNOWN)


def asks_shelter(code: ColumnLike) -> Column:
    return within(code, L.SHELTER_CODES).cast("int")


def is_veteran(status: ColumnLike) -> Column:
    """Condition on one row; missing when the status is."""
    return as_column(status) == L.VETERAN_YES


def yes_no(flag: ColumnLike) -> Column:
    return strict_if(as_column(flag) == 1, "Yes", "No")


def age_bucket(age: ColumnLike) -> Column:
    age = as_column(age)
    rules = [(age <= top, label) for label, top in L.AGE_BUCKETS if top is not None]
    last = L.AGE_BUCKETS[-1][0]
    return first_match([*rules, (age.isNotNull(), last)], otherwise=L.UNKNOWN)


def on_active_list(
    newly: ColumnLike, status: ColumnLike, status_date: ColumnLike, start: Column, end: Column
) -> Column:
    """Newly homeless, still active, or housed within the report year."""
    newly, status = as_column(newly), as_column(status)
    return (
        (newly == L.NEWLY_HOMELESS)
        | status.isin(list(L.ACTIVE_STATUSES))
        | ((status == L.HOUSED) & in_window(status_date, start, end))
    )


def white_or_bipoc(race: ColumnLike, ethnicity: ColumnLike) -> Column:
    """Two-way comparison group; unknown stays missing."""
    white = (as_column(race) == L.WHITE) & (as_column(ethnicity) != L.HISPANIC)
    return strict_if(white, "White", "BIPOC")


def has_usable_race(race: ColumnLike, ethnicity: ColumnLike) -> Column:
    """Drops refusals and missing collection, unless the ethnicity decides the group."""
    race = as_column(race)
    return (as_column(ethnicity) == L.HISPANIC) | (
        ~race.contains("Client") & ~race.contains("Data")
    )


def target_or_other(group: ColumnLike, targets: Sequence[str]) -> Column:
    return F.when(within(group, targets), target_label(targets)).otherwise("Other")


def target_label(targets: Sequence[str]) -> str:
    return targets[0] if len(targets) == 1 else "Selected Groups"
