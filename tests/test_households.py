import datetime as dt

from pyspark.sql import functions as F

from tallyhouse.functions import labels as L
from tallyhouse.operators.households import household_members, household_type, largest_household
from tallyhouse.plans import by_name_list

CLIENTS = "client_id long, gender string, age_at_year_end int"
MEMBERS = "client_id long, household_id string, relationship string"


def rolled(frame, clients, memberships):
    members = household_members(frame(CLIENTS, *clients), frame(MEMBERS, *memberships))
    return {r.client_id: r for r in largest_household(members).collect()}


def test_largest_household_wins_and_ties_go_to_the_smaller_id(frame):
    clients = [(1, "Female", 30), (2, "Male", 10), (3, "Male", 50), (4, "Male", 20)]
    memberships = [(1, "B", "Self"), (2, "B", "Child"), (1, "A", "Self"), (3, "A", "Partner"), (4, "C", "Self"), (1, "C", "Child"), (2, "C", "Child")]
    rows = rolled(frame, clients, memberships)
    assert {c: rows[c].household_id for c in rows} == {1: "C", 2: "C", 3: "A", 4: "C"}
    assert rows[3].household_size == 2 and rows[3].max_household_age == 50


def test_clients_without_membership_share_the_missing_household(frame):
    rows = rolled(frame, [(1, "Female", 30), (2, "Male", None), (3, "Male", 5)], [(3, "A", "Self")])
    assert rows[1].household_id is None and rows[1].household_size == 2
    assert rows[1].has_child is None and rows[1].self_partner_only == 0
    assert rows[3].household_size == 1 and rows[3].has_child == 0


def test_repeated_rows_count_in_the_size(frame):
    clients = [(1, "Female", 30)] * 3 + [(2, "Male", 40)]
    rows = rolled(frame, clients, [(1, "A", "Self"), (1, "A", "Self"), (2, "A", "Partner")])
    assert rows[1].household_size == 3 * 2 + 1


def test_missing_client_id_joins_missing(frame):
    rows = rolled(frame, [(None, "Female", 30)], [(None, "A", "Self")])
    assert rows[None].household_id == "A"


def typed(frame, unknown_age="infinite", **values):
    base = {
        "household_size": 2, "min_household_age": 30, "self_partner_only": 0, "has_child": 0, "has_parent": 0,
        "spans_generations": 0, "has_other_family": 0, "gender": "Female",
    }
    row = {**base, **values}
    schema = ", ".join(f"{c} {'string' if c == 'gender' else 'int'}" for c in row)
    return frame(schema, tuple(row.values())).select(household_type(unknown_age)).first()[0]


def test_household_type_rules(frame):
    single = {"household_size": 1}
    assert typed(frame, min_household_age=17) == "Family With Children"
    assert typed(frame, **single) == "Single Female"
    assert typed(frame, gender="Trans Man", **single) == "Single Male"
    assert typed(frame, gender="Data not collected", **single) == "Single Person - Gender Unknown"
    assert typed(frame, gender=None) == "Single Person - Gender Unknown"
    assert typed(frame, gender="Non Binary", **single) == "Single Non-Binary Person"
    assert typed(frame, self_partner_only=1) == "Couple"
    assert typed(frame, has_parent=1) == "Household with Adult Child/ren"
    assert typed(frame, has_other_family=1) == "Other Familial Relationship"
    assert typed(frame) == "Adults Only, Relationship Unknown"


def test_unknown_ages_count_as_adults_unless_asked(frame):
    unknown = {"min_household_age": None}
    assert typed(frame, has_child=1, **unknown) == "Household with Adult Child/ren"
    assert typed(frame, **unknown) == "Adults Only, Relationship Unknown"
    assert typed(frame, "null", has_child=1, **unknown) == "Household with Child/ren, Age Unknown"
    assert typed(frame, "null", **unknown) == "Cannot Determine"


def test_every_relationship_code_is_mapped(frame):
    codes = [c for codes in L.RELATIONSHIPS.values() for c in codes] + [None]
    df = frame(MEMBERS, *[(1, "A", c) for c in codes])
    assert by_name_list.unmapped_relationships(df).count() == 0
    extra = by_name_list.unmapped_relationships(df.withColumn("relationship", F.lit("roommate")))
    assert [r[0] for r in extra.collect()] == ["roommate"]


def test_report_invariants(frame):
    day = dt.date(2022, 5, 1)
    clients = frame(
        "client_id long, birth_date date, gender string, census_race string, ethnicity string, client_status string, newly_homeless string, status_date date, veteran string",
        (1, dt.date(1990, 1, 1), "Female", "Other Multi-Racial", None, "Active", None, day, "Yes"),
        (2, dt.date(2015, 1, 1), "Male", L.WHITE, L.HISPANIC, "Active", "Newly Homeless", day, "No"),
        (3, None, None, None, None, "Housed", None, day, None),
        (4, dt.date(1950, 1, 1), "Male", L.WHITE, "x", "Housed", None, dt.date(2021, 1, 1), "Yes"),
        (5, dt.date(1950, 1, 1), "Male", L.WHITE, "x", "Inactive", None, day, "Yes"),
    )
    memberships = frame(MEMBERS, (1, "A", "Self (head of household)"), (2, "A", "son"), (4, "Z", "Self"))
    got = {r.metric: r.value for r in by_name_list.report(clients, memberships, "20220101", "20221231").collect()}
    assert got["All people"] == 3 and got["Total households"] == 2 and got["Families"] == 1
    assert got["Veterans"] == 1 and got["Children"] == 1 and got["BIPOC"] == 2 and got["BIPOC Households"] == 1
    assert got["Newly homeless in families"] == 1 and got["Families with newly homeless adult"] == 0
    assert got["Families"] <= got["Total households"]
