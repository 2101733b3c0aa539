import datetime as dt

from tallyhouse.functions import labels as L
from tallyhouse.plans import program_entry

ENTRIES = (
    "household_key long, group_uid long, client_id long, provider_id long, program_type string, entry_ts timestamp_ntz, "
    "exit_date date, exit_destination string, age_at_entry int"
)
DEMOGRAPHICS = (
    "client_id long, score double, tie_key long, veteran_status string, primary_race string, secondary_race string, ethnicity string"
)
LATE = dt.datetime(2022, 12, 31, 23, 59)
BEFORE = dt.datetime(2021, 6, 1)
RRH = L.HOUSING_PROGRAMS[1]


def stays(frame):
    return frame(
        ENTRIES,
        (1, 10, 1, 7, L.EMERGENCY_SHELTER, LATE, None, None, 40),
        (1, 10, 2, 7, L.EMERGENCY_SHELTER, LATE, None, None, 9),
        (2, 20, 3, 8, RRH, LATE, None, None, None),
        (2, 20, 4, 8, RRH, LATE, None, None, 12),
        (None, 30, None, 9, RRH, LATE, None, None, 60),
        (4, 40, 5, 9, L.PREVENTION, BEFORE, dt.date(2022, 1, 1), L.PERMANENT, 22),
        (4, 40, 5, 9, L.COORDINATED_ENTRY, BEFORE, None, None, 22),
        (5, 50, 6, 9, RRH, BEFORE, None, None, 30),
    )


def people(frame):
    return frame(
        DEMOGRAPHICS,
        (1, 5.0, 1, "No (HUD)", L.WHITE, None, None),
        (1, 9.0, 2, "Yes (HUD)", "Other", None, None),
        (1, None, 3, "No (HUD)", L.WHITE, None, None),
        (None, 1.0, 1, "Yes (HUD)", L.WHITE, None, L.HISPANIC),
        (5, 1.0, 1, None, L.WHITE, "Asian or Asian American (HUD)", None),
    )


def test_system_map(frame):
    rows = program_entry.system_map(stays(frame), people(frame), "20220101", "20221231").collect()
    got = {(r.population, r.metric): r.value for r in rows}
    assert len(got) == 36
    everyone = [v for (p, _), v in got.items() if p == "All Households"]
    assert everyone == [1, 0, 0, 1, 2, 1]
    assert got["Families With Children", "Entered shelter"] == 1
    # One unknown age makes the ages of the group unknown.
    assert got["Families With Children", "Entered TH/RRH/PSH program"] == 0
    # The best-scored row decides; a missing client matches a missing client.
    assert got["Veterans", "Entered shelter"] == 1 and got["Veterans", "Entered TH/RRH/PSH program"] == 1
    assert got["Youth Households", "Stabilized through prevention"] == 1
    assert got["Seniors 55+", "Entered TH/RRH/PSH program"] == 1
    assert got["BIPOC Households", "Stabilized through prevention"] == 1
    assert got["BIPOC Households", "Entered TH/RRH/PSH program"] == 1


def test_summary_agrees_with_the_system_map(frame):
    providers = frame("agency long, provider_id long", (100, 8), (100, 8), (200, 8))
    summary = program_entry.program_summary(stays(frame), providers, "20220101", "20221231")
    # Provider 9 has no agency, which counts as one more.
    assert {r.metric: r.value for r in summary.collect()} == {"Agencies": 3, "Programs": 2, "Households": 2}
    types = program_entry.program_types(stays(frame), providers, "20220101", "20221231")
    assert [tuple(r) for r in types.collect()] == [(RRH, 2)]
