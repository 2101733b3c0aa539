"""Queries over joins, aggregates, windows, composite pipelines and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import recode
from ..functions.missing import all_flag, any_flag, largest, smallest
from ..operators import households, identity
from ..operators.keyed import attach, join_on, weighted_left_join
from ..operators.metrics import (
    Metric,
    distinct_counts,
    distinct_pairs_per,
    distinct_values,
    rows_per,
)
from ..plans import by_name_list, hotline, program_entry
from ..session import shared_folder
from ..sources import sheets
from .column_queries import END, ENTRY_END, ENTRY_START, START, raw_client_sheet
from .ctes import CENSUS, ENTRY_YEAR, bipoc, counts, words
from .registry import query


def _members(t):
    return by_name_list.list_members(t.clients, START, END)


def _household_members(t):
    return households.household_members(_members(t), by_name_list.cleaned_memberships(t.memberships))


def _assigned(t):
    return by_name_list.assigned_households(_members(t), t.memberships)


def _roster(t):
    members = _members(t)
    return by_name_list.roster(members, by_name_list.assigned_households(members, t.memberships))


def _calls(t, variant="v3"):
    return hotline.all_calls(t.calls, t.situations, t.caller_demographics, t.callpoint, variant)


def _resolved(t, variant="v3"):
    return identity.resolved_calls(_calls(t, variant))


def _folded(rows):
    return rows.groupBy(*[c for c in rows.columns if c != "copies"]).agg(F.sum("copies").alias("copies"))


# --- joins --------------------------------------------------------------------


@query(
    "j1_clients_with_households",
    """SELECT client_id, gender, household_id, relationship, count(*) AS copies FROM household_members GROUP BY 1, 2, 3, 4""",
)
def clients_with_households(t):
    memberships = by_name_list.cleaned_memberships(t.memberships)
    rows = weighted_left_join(_members(t).select("client_id", "gender"), memberships, ["client_id"])
    return _folded(rows)


@query(
    "j2_calls_with_situations",
    """SELECT c.client_id, c.need_date, c.need_code, s.prior_situation, count(*) AS copies FROM calls c LEFT JOIN situations s
      ON c.client_id IS NOT DISTINCT FROM s.client_id AND c.need_date IS NOT DISTINCT FROM s.event_date GROUP BY 1, 2, 3, 4""",
)
def calls_with_situations(t):
    calls = t.calls.select("client_id", "need_date", "need_code")
    situations = t.situations.select("client_id", F.col("event_date").alias("need_date"), "prior_situation")
    return _folded(weighted_left_join(calls, situations, ["client_id", "need_date"]))


@query(
    "j3_calls_with_demographics",
    """SELECT c.client_id, c.need_date, c.need_code, d.birth_date, d.primary_race FROM calls c
      LEFT JOIN caller_demographics d ON c.client_id IS NOT DISTINCT FROM d.client_id""",
)
def calls_with_demographics(t):
    people = t.caller_demographics.select("client_id", "birth_date", "primary_race")
    return join_on(t.calls.select("client_id", "need_date", "need_code"), people, ["client_id"])


@query(
    "j4_entries_with_agencies",
    "SELECT household_key, client_id, provider_id, program_type, agency FROM housing_entries",
)
def entries_with_agencies(t):
    rows = program_entry.housing_entries(t.entries, t.providers, ENTRY_START, ENTRY_END)
    return rows.select("household_key", "client_id", "provider_id", "program_type", "agency")


@query(
    "j5_veteran_entries",
    "SELECT household_key, client_id, program_type, age_at_entry FROM veteran_entries",
)
def veteran_entries(t):
    veterans = program_entry.scored_demographics(t.demographics).filter(
        F.col("veteran_status") == L.VETERAN_YES
    )
    rows = t.entries.select("household_key", "client_id", "program_type", "age_at_entry")
    return join_on(rows, veterans.select("client_id"), ["client_id"], "left_semi")


@query("j6_h4_merged_calls", "SELECT * FROM merged")
def merged_calls(t):
    return _calls(t)


@query(
    "u2_merged_sources",
    """SELECT housed_status, asked_shelter IS NULL AS callpoint_only, count(*) AS n FROM merged GROUP BY 1, 2""",
)
def merged_sources(t):
    rows = _calls(t).select("housed_status", F.col("asked_shelter").isNull().alias("callpoint_only"))
    return rows_per(rows, "housed_status", "callpoint_only")


# --- aggregations -------------------------------------------------------------


@query("a1_rows_per_group", "SELECT household_id, count(*) AS n FROM calls GROUP BY 1")
def rows_per_group(t):
    return rows_per(t.calls, "household_id")


@query("a2_distinct_keys", "SELECT count(*) AS n FROM (SELECT DISTINCT household_id FROM calls)")
def distinct_keys(t):
    return distinct_values(t.calls, "household_id")


@query(
    "a3_conditional_distinct_counts",
    counts(
        "calls",
        [
            ("All", "Households", "household_id", "true"),
            ("All", "Households asking for shelter", "household_id", f"need_code IN {words(L.SHELTER_CODES)}"),
            ("All", "Veterans", "client_id", "veteran_status = 'Yes (HUD)'"),
            ("All", "Named clients", "client_id", "name_string IS NOT NULL"),
            ("All", "Call days", "need_date", "true"),
        ],
    ),
)
def conditional_distinct_counts(t):
    return distinct_counts(
        t.calls,
        [
            Metric("Households", "household_id", F.lit(True)),
            Metric("Households asking for shelter", "household_id", F.col("need_code").isin(list(L.SHELTER_CODES))),
            Metric("Veterans", "client_id", F.col("veteran_status") == L.VETERAN_YES),
            Metric("Named clients", "client_id", F.col("name_string").isNotNull()),
            Metric("Call days", "need_date", F.lit(True)),
        ],
    )


@query(
    "a4_distinct_pairs",
    "SELECT program_type, count(*) AS n FROM (SELECT DISTINCT provider_id, program_type FROM entries) GROUP BY 1",
)
def distinct_pairs(t):
    return distinct_pairs_per(t.entries, "provider_id", "program_type")


@query("a5_distinct_rows", "SELECT DISTINCT client_id, need_code FROM calls")
def distinct_rows(t):
    return t.calls.select("client_id", "need_code").distinct()


@query(
    "a8_a9_group_flags",
    """SELECT client_id, max(CASE WHEN need_code = 'Emergency Shelter' THEN 1 ELSE 0 END) AS any_shelter,
      min(CASE WHEN need_code = 'Emergency Shelter' THEN 1 ELSE 0 END) AS all_shelter,
      CASE WHEN count(name_string) = count(*) THEN max(CASE WHEN name_string = 'P7' THEN 1 ELSE 0 END) END AS any_p7,
      CASE WHEN count(veteran_status) = count(*) THEN min(CASE WHEN veteran_status = 'Yes (HUD)' THEN 1 ELSE 0 END) END AS all_veteran
      FROM calls GROUP BY 1""",
)
def group_flags(t):
    shelter = F.col("need_code") == "Emergency Shelter"
    return t.calls.groupBy("client_id").agg(
        any_flag(shelter).alias("any_shelter"),
        all_flag(shelter).alias("all_shelter"),
        any_flag(F.col("name_string") == "P7").alias("any_p7"),
        all_flag(recode.is_veteran("veteran_status")).alias("all_veteran"),
    )


@query(
    "a10_extremum_policies",
    """SELECT provider_id, max(age_at_entry) AS oldest, min(age_at_entry) AS youngest,
      CASE WHEN count(age_at_entry) = count(*) THEN max(age_at_entry) END AS oldest_if_known,
      CASE WHEN count(age_at_entry) = count(*) THEN min(age_at_entry) END AS youngest_if_known,
      coalesce(min(CASE WHEN age_at_entry > 78 THEN age_at_entry END), 1e9) >= 18 AS no_minor_above
      FROM entries GROUP BY 1""",
)
def extremum_policies(t):
    age = F.col("age_at_entry")
    return t.entries.groupBy("provider_id").agg(
        largest(age, "skip").alias("oldest"),
        smallest(age, "skip").alias("youngest"),
        largest(age, "propagate").alias("oldest_if_known"),
        smallest(age, "propagate").alias("youngest_if_known"),
        (smallest(F.when(age > 78, age), "infinite") >= 18).alias("no_minor_above"),
    )


# --- per-key columns ----------------------------------------------------------


@query(
    "w1_household_size",
    "SELECT client_id, need_date, household_id, count(*) OVER (PARTITION BY household_id) AS calls_of_household FROM calls",
)
def household_size(t):
    rows = t.calls.select("client_id", "need_date", "household_id")
    return attach(rows, ["household_id"], calls_of_household=F.count(F.lit(1)))


@query(
    "w2_group_ages",
    "SELECT group_uid, client_id, age_at_entry, max_entry_age, min_entry_age FROM aged_entries",
)
def group_ages(t):
    rows = program_entry.with_group_ages(t.entries.select("group_uid", "client_id", "age_at_entry"))
    return rows.select("group_uid", "client_id", "age_at_entry", "max_entry_age", "min_entry_age")


@query(
    "w3_two_key_groups",
    """SELECT name_string, birth_date, client_id, min(client_id) OVER p AS smallest_id, count(*) OVER p AS calls_of_person FROM callpoint
      WINDOW p AS (PARTITION BY name_string, birth_date)""",
)
def two_key_groups(t):
    rows = t.callpoint.select("name_string", "birth_date", "client_id")
    return attach(
        rows,
        ["name_string", "birth_date"],
        smallest_id=F.min("client_id"),
        calls_of_person=F.count(F.lit(1)),
    )


@query(
    "w4_filled_birth_dates",
    """SELECT client_id, name_string, coalesce(birth_date, max(birth_date) OVER (PARTITION BY name_string)) AS birth_date FROM callpoint""",
)
def filled_birth_dates(t):
    rows = attach(
        t.callpoint.select("client_id", "name_string", "birth_date"),
        ["name_string"],
        latest=F.max("birth_date"),
    )
    return rows.withColumn("birth_date", F.coalesce("birth_date", "latest")).drop("latest")


@query("w5_o2_best_scored", "SELECT * FROM best_demographics")
def best_scored(t):
    return program_entry.scored_demographics(t.demographics)


# --- classification -----------------------------------------------------------


@query(
    "c3_household_type",
    "SELECT client_id, household_id, household_type, household_type_live FROM typed",
)
def household_types(t):
    typed = by_name_list.typed_households(_assigned(t))
    return typed.select(
        "client_id",
        "household_id",
        "household_type",
        households.household_type("null").alias("household_type_live"),
    )


@query("c8_household_day_status", "SELECT DISTINCT household_id, call_date, housed_status, day_status FROM with_day_v2")
def household_day_status(t):
    rows = identity.household_day_status(_resolved(t, "v2"))
    return rows.select("household_id", "call_date", "housed_status", "day_status").distinct()


@query(
    "c9_c10_client_flags",
    "SELECT DISTINCT client_id, asked_shelter, veteran FROM flagged_v1",
)
def client_flags(t):
    return t.calls.groupBy("client_id").agg(
        recode.yes_no(F.max(recode.asks_shelter("need_code"))).alias("asked_shelter"),
        recode.yes_no(any_flag(recode.is_veteran("veteran_status"))).alias("veteran"),
    )


# --- composite pipelines ------------------------------------------------------

_MEASURES = (
    "household_size",
    "max_household_age",
    "min_household_age",
    "self_partner_only",
    "has_child",
    "has_parent",
    "all_heads",
    "spans_generations",
    "has_other_family",
)


@query(
    "h1_household_rollup",
    f"SELECT DISTINCT household_id, {', '.join(_MEASURES)} FROM household_members",
)
def household_rollup(t):
    return _household_members(t).select("household_id", *_MEASURES).distinct()


@query("h2_household_per_client", "SELECT * FROM assigned")
def household_per_client(t):
    return _assigned(t)


@query("h3_h5_resolved_calls", "SELECT DISTINCT * FROM resolved_v3")
def resolved_calls(t):
    return _resolved(t).distinct()


@query("h3_h5_resolved_calls_v2", "SELECT DISTINCT * FROM resolved_v2")
def resolved_calls_v2(t):
    return _resolved(t, "v2").distinct()


@query("h6_summary_base", "SELECT * FROM base_v3")
def summary_base(t):
    return identity.summary_base(_resolved(t))


@query("h6_summary_base_v2", "SELECT * FROM base_v2")
def summary_base_v2(t):
    return identity.summary_base(_resolved(t, "v2"), "v2")


@query("h7_single_sheet_base", "SELECT * FROM base_v1")
def single_sheet_base(t):
    return identity.single_sheet_base(t.calls)


# --- reports ------------------------------------------------------------------

_ADULT_BIPOC = f"{bipoc(['census_race'], 'ethnicity', *CENSUS)} = 1 AND age_at_year_end >= 18"
_SYSTEM_MAP = [
    ("All", "Total households", "household_id", "true"),
    ("All", "Families", "household_id", "min_household_age < 18"),
    ("All", "Veterans", "client_id", "veteran = 'Yes'"),
    ("All", "Youth households", "household_id", "max_household_age >= 18 AND max_household_age <= 24"),
    ("All", "Seniors 55+", "client_id", "age_at_year_end >= 55"),
    ("All", "BIPOC Households", "household_id", _ADULT_BIPOC),
]
_CLIENTS = [
    ("All", "All people", "client_id", "true"),
    ("All", "Children", "client_id", "age_at_year_end < 18"),
    ("All", "BIPOC", "client_id", f"{bipoc(['census_race'], 'ethnicity', *CENSUS)} = 1"),
    ("All", "Women + NB", "client_id", "gender IN ('Female', 'Non Binary', 'Trans Woman')"),
    ("All", "Newly Homeless", "client_id", "newly_homeless IS NOT NULL"),
    ("All", "Latinx", "client_id", f"ethnicity IN {words([L.HISPANIC, L.HISPANIC_OLD])}"),
]
_FAMILIES = [
    ("All", "People in families", "client_id", "min_household_age < 18"),
    ("All", "Newly homeless in families", "client_id", "min_household_age < 18 AND newly_homeless IS NOT NULL"),
    ("All", "Families with newly homeless", "household_id", "min_household_age < 18 AND newly_homeless IS NOT NULL"),
    (
        "All",
        "Families with newly homeless adult",
        "household_id",
        "min_household_age < 18 AND newly_homeless IS NOT NULL AND age_at_year_end >= 18",
    ),
]


@query("r1_list_system_map", counts("roster", _SYSTEM_MAP))
def list_system_map(t):
    return by_name_list.system_map(_roster(t))


@query("r2_client_counts", counts("list_members", _CLIENTS))
def client_counts(t):
    return by_name_list.client_counts(_members(t))


@query("s5_r2_client_counts_from_sheet", counts("list_members", _CLIENTS))
def client_counts_from_sheet(t):
    members = by_name_list.list_members(sheets.client_sheet(raw_client_sheet(t)), START, END)
    return by_name_list.client_counts(members)


@query("r3_age_table", "SELECT bucket AS age_bucket, count(*) AS people FROM (SELECT CASE "
    + " ".join(f"WHEN age_at_year_end <= {top} THEN '{label}'" for label, top in L.AGE_BUCKETS if top is not None)
    + " WHEN age_at_year_end >= 70 THEN '70+' ELSE 'Unknown' END AS bucket FROM list_members) GROUP BY 1")
def age_table(t):
    return by_name_list.age_table(_members(t))


@query(
    "r3_race_table",
    f"""SELECT CASE WHEN split IN {words(L.RACE_LEVELS)} THEN split END AS race, count(*) AS people FROM (
      SELECT CASE WHEN census_race = 'White (HUD)' AND ethnicity <> '{L.HISPANIC}' THEN 'White, Non-Hispanic'
        WHEN NOT (census_race = 'White (HUD)' AND ethnicity <> '{L.HISPANIC}') THEN census_race END AS split FROM list_members)
      GROUP BY 1""",
)
def race_table(t):
    return by_name_list.race_table(_members(t))


@query("r3_gender_table", "SELECT gender, count(*) AS people FROM list_members GROUP BY 1")
def gender_table(t):
    return by_name_list.gender_table(_members(t))


@query(
    "r3_bipoc_ethnicity_table",
    f"SELECT ethnicity, count(*) AS households FROM roster WHERE {_ADULT_BIPOC} GROUP BY 1",
)
def bipoc_ethnicity_table(t):
    return by_name_list.bipoc_ethnicity_table(_members(t))


@query("r4_family_follow_ups", counts("roster", _FAMILIES))
def family_follow_ups(t):
    return by_name_list.family_follow_ups(_roster(t))


@query(
    "r5_household_type_table",
    "SELECT household_type, count(*) AS households FROM (SELECT DISTINCT household_id, household_type FROM typed) GROUP BY 1",
)
def household_type_table(t):
    return by_name_list.household_type_table(_assigned(t))


def _housing(condition: str) -> str:
    return f"program_type IN {words(L.HOUSING_PROGRAMS)} AND {condition}"


_ENTERED = f"CAST(entry_ts AS DATE) BETWEEN {ENTRY_YEAR[0]} AND {ENTRY_YEAR[1]}"
_LEFT = f"exit_destination = 'Permanent Situation' AND exit_date BETWEEN {ENTRY_YEAR[0]} AND {ENTRY_YEAR[1]}"
_STAYS = [
    ("Entered shelter", f"program_type = '{L.EMERGENCY_SHELTER}' AND {_ENTERED}"),
    ("Entered diversion", f"program_type = 'Diversion' AND {_ENTERED}"),
    ("Housed through diversion", f"program_type = 'Diversion' AND {_LEFT}"),
    ("Were open in CE", f"program_type = '{L.COORDINATED_ENTRY}'"),
    ("Entered TH/RRH/PSH program", _housing(_ENTERED)),
    ("Stabilized through prevention", f"program_type = '{L.PREVENTION}' AND {_LEFT}"),
]
_POPULATIONS = [
    ("All Households", "household_key", "aged_entries", "true"),
    ("Families With Children", "household_key", "aged_entries", "min_entry_age < 18"),
    ("Veterans", "client_id", "veteran_entries", "true"),
    ("Youth Households", "household_key", "aged_entries", "max_entry_age >= 18 AND max_entry_age <= 24"),
    ("Seniors 55+", "client_id", "aged_entries", "age_at_entry >= 55"),
    ("BIPOC Households", "household_key", "bipoc_entries", "true"),
]
_PROGRAM_MAP = "\nUNION ALL\n".join(
    counts(source, [(title, name, key, f"({where}) AND {stay}") for name, stay in _STAYS])
    for title, key, source, where in _POPULATIONS
)
_PROGRAM_SUMMARY = counts(
    "housing_entries",
    [("All", "Agencies", "agency", "true"), ("All", "Programs", "provider_id", "true"), ("All", "Households", "household_key", "true")],
)


@query("r6_program_system_map", _PROGRAM_MAP)
def program_system_map(t):
    return program_entry.system_map(t.entries, t.demographics, ENTRY_START, ENTRY_END)


@query("r7_program_summary", _PROGRAM_SUMMARY)
def program_summary(t):
    return program_entry.program_summary(t.entries, t.providers, ENTRY_START, ENTRY_END)


@query(
    "r7_program_types",
    "SELECT program_type, count(*) AS programs FROM (SELECT DISTINCT provider_id, program_type FROM housing_entries) GROUP BY 1",
)
def program_types(t):
    return program_entry.program_types(t.entries, t.providers, ENTRY_START, ENTRY_END)


def _call_counts(source: str, v1: bool = False) -> str:
    base = [
        ("All households", "household_id", "true"),
        ("Families", "household_id", "min_age < 18"),
        ("Veterans", "client_id", "veteran = 'Yes'"),
        ("Youth households", "household_id", "max_age >= 18 AND max_age <= 24"),
        ("Seniors", "client_id", "age >= 55"),
    ]
    titles = [("All Calling", "true")]
    if not v1:
        base.append(("BIPOC households", "household_id", "(max_age >= 18 OR max_age IS NULL) AND bipoc = 1"))
        titles += [
            ("Literally Homeless Calling", "housed_status = 'Literally Homeless'"),
            ("Not Homeless/Unknown Calling", "housed_status <> 'Literally Homeless'"),
        ]
    metrics = [
        (title, f"{label} {suffix}", key, f"{group} AND {where} AND {extra}")
        for title, group in titles
        for label, key, where in base
        for suffix, extra in (("calling", "true"), ("calling for shelter", "asked_shelter = 'Yes'"))
    ]
    return counts(source, metrics, "hotline")


@query("r8_hotline", _call_counts("base_v3"))
def hotline_report(t):
    return hotline.report(t.calls, t.situations, t.caller_demographics, t.callpoint)


@query("r8_hotline_v2", _call_counts("base_v2"))
def hotline_report_v2(t):
    return hotline.report(t.calls, t.situations, t.caller_demographics, t.callpoint, "v2")


@query("r8_hotline_v1", _call_counts("base_v1", v1=True))
def hotline_report_v1(t):
    return hotline.single_sheet_report(t.calls)


@query(
    "r9_unmapped_relationships",
    f"SELECT DISTINCT relationship FROM known_memberships WHERE relationship NOT IN {words(L.RELATIONSHIPS)}",
)
def unmapped_relationships(t):
    return by_name_list.unmapped_relationships(t.memberships)


@query(
    "r9_undetermined_households",
    "SELECT client_id, household_id, gender, household_type_live AS household_type FROM typed WHERE household_type_live = 'Cannot Determine'",
)
def undetermined_households(t):
    rows = by_name_list.undetermined_households(_assigned(t), "null")
    return rows.select("client_id", "household_id", "gender", "household_type")


@query(
    "r9_people_per_status",
    "SELECT housed_status, count(*) AS people FROM (SELECT DISTINCT name_string, birth_date, housed_status FROM resolved_v3) GROUP BY 1",
)
def people_per_status(t):
    return hotline.people_per_status(_resolved(t))


@query("s10_report_sink", _call_counts("base_v1", v1=True))
def report_sink(t):
    path = shared_folder(t.spark)
    sheets.write_report(hotline.single_sheet_report(t.calls), path)
    return t.spark.read.parquet(path)


@query(
    "s10_list_report",
    "\nUNION ALL\n".join(counts("roster", m, "by_name_list") for m in (_SYSTEM_MAP, _CLIENTS, _FAMILIES)),
)
def list_report(t):
    return by_name_list.report(t.clients, t.memberships, START, END)


@query(
    "s10_program_report",
    f"SELECT 'program_entry' AS report, * FROM (\n{_PROGRAM_MAP}\nUNION ALL\n{_PROGRAM_SUMMARY}\n)",
)
def program_report(t):
    return program_entry.report(t.entries, t.demographics, t.providers, ENTRY_START, ENTRY_END)
