import datetime as dt

from tallyhouse.functions import labels as L
from tallyhouse.operators import identity
from tallyhouse.operators.keyed import merge_unmatched, weighted_left_join
from tallyhouse.plans import hotline

DAY = dt.date(2022, 3, 1)
BORN = dt.date(1990, 5, 5)
CALLS = (
    "household_id string, client_id long, call_date date, veteran_status string, name_string string, "
    "birth_date date, housed_status string, bipoc int, asked_shelter int"
)


def call(household=None, client=1, date=DAY, veteran="No (HUD)", name="P", born=BORN, status=L.LITERALLY, bipoc=0, shelter=0):
    return (household, client, date, veteran, name, born, status, bipoc, shelter)


def resolved(frame, *calls):
    return identity.resolved_calls(frame(CALLS, *calls)).collect()


def test_smallest_positive_id_is_canonical(frame):
    rows = resolved(frame, call(client=-5), call(client=9), call(client=4))
    assert {r.client_id for r in rows} == {4} and {r.household_id for r in rows} == {"4-C"}


def test_without_positive_id_the_largest_is_used(frame):
    assert {r.client_id for r in resolved(frame, call(client=-5), call(client=-2))} == {-2}


def test_missing_birth_date_takes_the_latest_of_the_name(frame):
    later = dt.date(1995, 1, 1)
    rows = resolved(frame, call(client=1, born=None), call(client=2), call(client=3, born=later), call(client=7, name="Q", born=None))
    assert {(r.client_id, r.birth_date) for r in rows} == {(1, later), (2, BORN), (7, None)}


def test_missing_names_are_one_group(frame):
    rows = resolved(frame, call(client=8, name=None, born=None), call(client=3, name=None, born=BORN))
    assert {r.client_id for r in rows} == {3}


def test_client_flags(frame):
    rows = resolved(
        frame,
        call(client=1, veteran="Yes (HUD)", shelter=1),
        call(client=1, veteran=None, bipoc=1, name="other name"),
        call(client=2, name="Q", veteran="Yes (HUD)", shelter=None),
    )
    flags = {(r.client_id, r.veteran, r.bipoc, r.asked_shelter) for r in rows}
    assert flags == {(1, None, 1, 1), (2, "Yes", 0, 0)}


def test_merge_equals_null_safe_full_join(frame):
    left = frame("h string, k int, d date, x int", ("a", 1, DAY, 1), ("b", 1, DAY, 2), (None, None, None, 3), ("c", 2, DAY, 4))
    right = frame("id int, day date", (1, DAY), (None, None), (None, None), (5, None), (5, None), (2, None))
    got = {tuple(r) for r in merge_unmatched(left, right, [("k", "id"), ("d", "day")]).collect()}
    extra = {(None, 5, None, None), (None, 2, None, None)}
    assert got == {tuple(r) for r in left.collect()} | extra


def test_many_to_many_join_counts_copies(frame):
    left = frame("k int, a string", (1, "x"), (1, "x"), (1, "y"), (2, "z"), (None, "n"))
    right = frame("k int, b string", (1, "p"), (1, "q"), (None, "r"))
    got = sorted(map(str, (tuple(r) for r in weighted_left_join(left, right, ["k"]).select("k", "a", "b", "copies").collect())))
    want = [(1, "x", "p", 2), (1, "x", "q", 2), (1, "y", "p", 1), (1, "y", "q", 1), (2, "z", None, 1), (None, "n", "r", 1)]
    assert got == sorted(map(str, want))


def test_hot_call_day_does_not_multiply(frame):
    """A client-day repeated on both sides stays linear in the calls."""
    calls = frame(
        "household_id string, client_id long, need_date date, need_code string, veteran_status string, name_string string",
        *[("h", 1, DAY, "Emergency Shelter", "No (HUD)", "P")] * 50,
    )
    situations = frame(
        "client_id long, event_date date, prior_situation string, fleeing_dv string",
        *[(1, DAY, s, f) for s in L.HOUSED_SITUATIONS for f in ("Yes", "No", None)],
    )
    people = frame(
        "client_id long, birth_date date, primary_race string, secondary_race string, ethnicity string",
        *[(1, BORN, None, None, None)] * 20,
    )
    rows = identity.classified_calls(calls, situations, people).collect()
    assert len(rows) == 1 and rows[0].housed_status == L.NOT_LITERALLY


def test_summary_base_picks_largest_then_status(frame):
    calls = frame(
        CALLS,
        call(household="A", client=1, status=L.NOT_LITERALLY),
        call(household="A", client=2, name="Q", status=L.NOT_LITERALLY, born=dt.date(2015, 1, 1)),
        call(household="B", client=1, status=L.LITERALLY),
        call(household="C", client=3, name="R", status=L.NOT_LITERALLY),
        call(household="D", client=3, name="R", status=L.LITERALLY),
    )
    base = {r.client_id: r for r in identity.summary_base(identity.resolved_calls(calls)).collect()}
    assert base[1].household_id == "A" and base[1].household_size == 2 and base[1].min_age == 7
    assert base[3].household_id == "D" and base[3].housed_status == L.LITERALLY


def test_day_status_is_the_strongest(frame):
    calls = frame("household_id string, call_date date, housed_status string", ("A", DAY, L.UNKNOWN), ("A", DAY, L.LITERALLY), ("A", None, L.NOT_LITERALLY))
    got = {tuple(r) for r in identity.household_day_status(calls).collect()}
    assert got == {
        ("A", DAY, L.UNKNOWN, L.LITERALLY),
        ("A", DAY, L.LITERALLY, L.LITERALLY),
        ("A", None, L.NOT_LITERALLY, L.NOT_LITERALLY),
    }


def test_single_sheet_ages_propagate_missing(frame):
    calls = frame(
        "household_id string, client_id long, need_code string, veteran_status string, supplied_age int",
        ("A", 1, "Emergency Shelter", "Yes (HUD)", 30),
        ("A", 2, "other", None, None),
        ("B", 3, "other", "No (HUD)", 20),
    )
    base = {r.client_id: r for r in identity.single_sheet_base(calls).collect()}
    assert base[1].max_age is None and base[1].asked_shelter == "Yes" and base[1].veteran == "Yes"
    assert base[2].veteran is None and base[3].max_age == 20


def test_populations_add_up(spark):
    from tallyhouse.catalog.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    rows = hotline.report(t.calls, t.situations, t.caller_demographics, t.callpoint).collect()
    got = {(r.population, r.metric): r.value for r in rows}
    everyone, literal, rest = "All Calling", "Literally Homeless Calling", "Not Homeless/Unknown Calling"
    for metric in ("Veterans calling", "Seniors calling"):
        assert got[everyone, metric] == got[literal, metric] + got[rest, metric]
    assert all(got[p, m] >= got[p, m + " for shelter"] for p, m in got if not m.endswith("shelter"))
