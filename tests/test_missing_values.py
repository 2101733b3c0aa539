"""One test per missing-value or type trap of the reports."""

import datetime as dt

from pyspark.sql import functions as F

from tallyhouse.functions import labels as L
from tallyhouse.functions import recode
from tallyhouse.functions.dates import completed_years, day, in_window
from tallyhouse.functions.missing import any_flag, down, largest, smallest, strict_if, up, within
from tallyhouse.functions.rules import client_household, only_levels, rank_of
from tallyhouse.operators.keyed import first_per_key, join_on
from tallyhouse.operators.metrics import Metric, distinct_counts, distinct_values, rows_per
from tallyhouse.operators.reshape import scaled


def values(df):
    return [tuple(r) for r in df.collect()]


def test_missing_key_counts_as_one_value(frame):
    df = frame("k int", (1,), (1,), (2,), (None,), (None,))
    assert values(distinct_values(df, "k")) == [(3,)]
    assert values(distinct_counts(df, [Metric("n", "k", F.lit(True))])) == [("All", "n", 3)]


def test_extremum_policies(frame):
    df = frame("k int, x int", (1, 5), (1, None), (2, None), (3, 7), (3, 4))
    got = values(
        df.groupBy("k")
        .agg(largest("x"), largest("x", "propagate"), largest("x", "infinite"), smallest("x", "infinite"))
        .orderBy("k")
    )
    inf = float("inf")
    assert got == [(1, 5, None, 5.0, 5.0), (2, None, None, -inf, inf), (3, 7, 7, 7.0, 4.0)]


def test_flag_is_missing_when_any_row_is(frame):
    df = frame("k int, s string", (1, "Yes (HUD)"), (1, None), (2, "Yes (HUD)"), (2, "No (HUD)"), (3, "No (HUD)"))
    flags = df.groupBy("k").agg(any_flag(recode.is_veteran("s")).alias("f")).orderBy("k")
    assert values(flags.select("k", recode.yes_no("f"))) == [(1, None), (2, "Yes"), (3, "No")]


def test_strict_choice_keeps_missing(frame):
    df = frame("x int", (1,), (0,), (None,))
    assert values(df.select(strict_if(F.col("x") == 1, "a", "b"))) == [("a",), ("b",), (None,)]


def test_membership_is_never_missing(frame):
    df = frame("x string", ("a",), ("c",), (None,))
    assert values(df.select(within("x", ["a", "b"]), ~within("x", ["a", "b"]))) == [
        (True, False),
        (False, True),
        (False, True),
    ]


def test_joins_match_missing_to_missing(frame):
    left = frame("k int, d date, a int", (1, None, 1), (None, None, 2), (3, None, 3))
    right = frame("k int, e date, b int", (1, None, 10), (None, None, 20))
    got = sorted(values(join_on(left, right, ["k", ("d", "e")]).select("a", "b")))
    assert got == [(1, 10), (2, 20), (3, None)]


def test_missing_group_is_kept(frame):
    df = frame("k string", ("a",), (None,), (None,))
    assert set(values(rows_per(df, "k"))) == {("a", 1), (None, 2)}


def test_sort_puts_missing_last_both_ways(frame):
    df = frame("x int", (2,), (None,), (1,))
    assert values(df.orderBy(up("x"))) == [(1,), (2,), (None,)]
    assert values(df.orderBy(down("x"))) == [(2,), (1,), (None,)]


def test_first_per_key_is_stable_under_repartitioning(frame):
    rows = [(k, s, t) for k in (1, 2, None) for s, t in ((5, 2), (5, 1), (None, 0), (3, 9))]
    df = frame("k int, score int, tie int", *rows)
    want = {(1, 5, 1), (2, 5, 1), (None, 5, 1)}
    for n in (1, 3, 7):
        got = first_per_key(df.repartition(n), ["k"], [down("score"), up("tie")])
        assert set(values(got)) == want


def test_labels_outside_levels_are_missing(frame):
    df = frame("x string", ("70+",), ("other",), (None,))
    assert values(df.select(only_levels("x", L.AGE_LEVELS), rank_of("x", L.AGE_LEVELS))) == [
        ("70+", 8),
        (None, None),
        (None, None),
    ]


def test_household_of_client_is_plain_text(frame):
    df = frame("id long", (100000,), (26,), (None,))
    assert values(df.select(client_household("id"))) == [("100000-C",), ("26-C",), ("NA-C",)]


def test_constant_factor_scales_to_missing(frame):
    df = frame("a double, b double, c double", (1.0, 5.0, 1.0), (3.0, 5.0, None), (2.0, 5.0, 3.0))
    loose = values(scaled(df, ["a", "b", "c"], strict=False))
    assert loose == [(0.0, None, 0.0), (1.0, None, None), (0.5, None, 1.0)]
    strict = values(scaled(df, ["a", "b", "c"], strict=True))
    assert [r[2] for r in strict] == [None, None, None]


def test_window_covers_the_whole_last_day(frame):
    late = dt.datetime(2022, 12, 31, 23, 59)
    df = frame("t timestamp_ntz", (late,), (dt.datetime(2023, 1, 1),), (dt.datetime(2022, 1, 1),), (None,))
    kept = df.filter(in_window("t", day("20220101"), day("20221231")))
    assert sorted(r[0] for r in values(kept)) == [dt.datetime(2022, 1, 1), late]


def test_age_of_leap_day_births(frame):
    df = frame(
        "a date, b date",
        (dt.date(2004, 2, 29), dt.date(2022, 2, 28)),
        (dt.date(2004, 2, 29), dt.date(2022, 3, 1)),
        (dt.date(2000, 6, 15), dt.date(2020, 6, 15)),
        (dt.date(2000, 6, 15), dt.date(2020, 6, 14)),
        (dt.date(2023, 6, 1), dt.date(2022, 12, 31)),
        (None, dt.date(2022, 12, 31)),
    )
    assert [r[0] for r in values(df.select(completed_years("a", "b")))] == [17, 18, 20, 19, -1, None]


def test_age_bucket_edges(frame):
    edges = [5, 6, 11, 12, 17, 18, 24, 25, 34, 35, 44, 45, 54, 55, 69, 70, None]
    df = frame("x int", *[(e,) for e in edges])
    got = [r[0] for r in values(df.select(recode.age_bucket("x")))]
    assert got == [b for b in L.AGE_LEVELS[:-1] for _ in (0, 1)][1:-1] + ["Unknown"]


def test_gender_recode_order(frame):
    cases = {
        "Transgender, Male to Female": "Trans Woman",
        "Transgender, Male": "Trans Man",
        "A gender that is non-binary": "Non Binary",
        "Female, Male": "Non Binary",
        "Female": "Female",
        "female": "female",
        None: None,
    }
    df = frame("x string", *[(c,) for c in cases])
    assert [r[0] for r in values(df.select(recode.gender("x")))] == list(cases.values())


def test_race_levels(frame):
    df = frame(
        "r string, e string",
        (L.WHITE, "Non-Hispanic/Non-Latin(a)(o)(x) (HUD)"),
        (L.WHITE, L.HISPANIC),
        (L.WHITE, None),
        ("Two or More Races", L.HISPANIC),
        ("Two or More Races", None),
        (None, None),
    )
    got = [r[0] for r in values(df.select(recode.race_level("r", "e")))]
    assert got == [L.WHITE_NON_HISPANIC, None, None, "Two or More Races", "Two or More Races", None]


def test_white_with_unknown_ethnicity_has_no_group(frame):
    df = frame("r string, e string", (L.WHITE, None), (L.WHITE, "x"), (L.WHITE, L.HISPANIC), ("Other", None), (None, "x"))
    got = [r[0] for r in values(df.select(recode.white_or_bipoc("r", "e")))]
    assert got == [None, "White", "BIPOC", "BIPOC", None]


def test_status_variants(frame):
    df = frame(
        "c string, s string, f string",
        (L.LITERAL_CODES[0], None, None),
        (None, L.LITERAL_SITUATIONS[2], None),
        (L.HOUSED_CODES[0], L.LITERAL_SITUATIONS[0], None),
        (L.HOUSED_CODES[0], None, "Yes"),
        ("Animal Shelters", None, "No"),
        ("Rent Payment Assistance", None, None),
        (None, None, None),
    )
    v2 = [r[0] for r in values(df.select(recode.housing_status("c", "s", "f", variant="v2")))]
    v3 = [r[0] for r in values(df.select(recode.housing_status("c", "s", "f")))]
    point = [r[0] for r in values(df.select(recode.housing_status("c", "s", "f", variant="v2", source="callpoint")))]
    lit, no, unknown = L.LITERALLY, L.NOT_LITERALLY, L.UNKNOWN
    assert v2 == [lit, lit, lit, lit, lit, no, unknown]
    assert v3 == [lit, lit, lit, no, no, no, no]
    assert point == [lit, lit, lit, lit, unknown, unknown, unknown]


def test_reduced_situation_gives_the_same_status(frame):
    situations = [*L.LITERAL_SITUATIONS, *L.HOUSED_SITUATIONS, "elsewhere", None]
    codes = [L.LITERAL_CODES[0], L.HOUSED_CODES[1], "Emergency Shelter", "Rent Payment Assistance", None]
    df = frame("c string, s string", *[(c, s) for c in codes for s in situations])
    df = df.withColumn("kind", recode.situation_kind("s")).withColumn("f", F.lit(None).cast("string"))
    for variant in ("v2", "v3"):
        full = recode.housing_status("c", "s", "f", variant=variant)
        reduced = recode.housing_status("c", "kind", "f", variant=variant)
        assert df.filter(~full.eqNullSafe(reduced)).count() == 0
