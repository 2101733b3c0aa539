"""Labels against the survey's own lists, which the checking SQL does not share."""

import re
from pathlib import Path

from tallyhouse.functions import labels as L

SECTION = re.search(r"## B\..*?(?=\n## C)", (Path(__file__).parents[1] / "FIXTURES.md").read_text(), re.S)[0]
LISTS = {
    name: [x.strip() for x in values.split(";")]
    for name, values in re.findall(r"^\| ([^|]+?) \| ([^|]+?) \| [^|]+ \|$", SECTION, re.M)
}


def test_plain_lists():
    for name, labels in {
        "race, BIPOC, current": L.BIPOC_RACES,
        "race, BIPOC, old": L.BIPOC_RACES_OLD,
        "race table levels (ordered)": L.RACE_LEVELS,
        "active statuses": L.ACTIVE_STATUSES,
        "women + NB": L.WOMEN_AND_NON_BINARY,
        "household types (rule order)": L.HOUSEHOLD_TYPES,
        "shelter need codes": L.SHELTER_CODES,
        "literal code": L.LITERAL_CODES,
        "housed codes (4)": L.HOUSED_CODES,
        "probable homeless codes (v2)": L.PROBABLY_LITERAL_CODES,
        "probable housed codes": L.PROBABLY_HOUSED_CODES,
    }.items():
        ordered = "order" in name
        assert list(labels) == LISTS[name] if ordered else sorted(labels) == sorted(LISTS[name]), name


def test_census_races():
    both = {x.replace("Other Multi-Racial", "Two or More Races") for k in ("current", "old") for x in LISTS[f"race, BIPOC, {k}"]}
    assert set(L.BIPOC_CENSUS_RACES) == both


def test_counts_of_the_situation_lists():
    assert (len(set(L.LITERAL_SITUATIONS)), len(set(L.HOUSED_SITUATIONS))) == (6, 22)
    assert not set(L.LITERAL_SITUATIONS) & set(L.HOUSED_SITUATIONS)


def test_relationships():
    for kind in ("Self", "Child", "Partner", "Sibling", "Parent", "Other Relative", "Unknown"):
        name = "relationship → Self" if kind == "Self" else f"→ {kind}"
        assert sorted(L.RELATIONSHIPS[kind]) == sorted(x for x in LISTS[name] if x != "null"), kind
