"""Queries over sources, projections, filters, scalar functions and recodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import recode
from ..functions.dates import completed_years, day, in_window
from ..functions.missing import down, strict_if, up, within
from ..functions.rules import client_household, rank_of
from ..operators import compare, reshape
from ..operators.keyed import join_on, weighted_left_join, with_copies
from ..operators.metrics import rows_per
from ..plans import by_name_list, equity
from ..session import shared_folder
from ..sources import headers, schemas, sheets
from .ctes import CENSUS, CURRENT, ENTRY_YEAR, OLD, YEAR, age_bucket, bipoc, gender, relationship, status, words, years
from .registry import query

START, END = "20220101", "20221231"
ENTRY_START, ENTRY_END = "20000101", "20001231"


# --- sources and cleaning -----------------------------------------------------


def raw_client_sheet(t):
    """The client list as extracts deliver it: spaced headers, the ninth one blank."""
    raw = {
        "client_id": "Client Id",
        "birth_date": "Date of Birth",
        "gender": "Gender",
        "census_race": "Census Race",
        "ethnicity": "Ethnicity",
        "client_status": "Client Status",
        "status_date": "Status Date",
        "veteran": "Veteran?",
        "newly_homeless": "_c8",
    }
    sheet = t.clients.select(*raw).withColumn("status_date", F.col("status_date").cast("timestamp_ntz"))
    return sheet.withColumnsRenamed(raw)


@query(
    "s1_s4_s5_s7_client_sheet",
    """SELECT client_id, birth_date, gender, census_race, ethnicity, client_status, status_date, veteran, newly_homeless
      FROM clients""",
)
def client_sheet(t):
    return sheets.client_sheet(raw_client_sheet(t))


@query("s1_named_sheet", "SELECT * FROM customer WHERE c_custkey NOT IN (1, 2)")
def named_sheet(t):
    """One sheet of the folder, by name, with a schema and without two records."""
    sheet = sheets.read_sheet(t.spark, t.folder, "customer.parquet", t.customer.schema)
    return sheets.cleaned_sheet(sheet, key="c_custkey", exclude=(1, 2))


@query("s3_table_by_file_name", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def table_by_file_name(t):
    return rows_per(sheets.read_table(t.spark, t.path("part")), "p_brand")


@query(
    "s2_csv_with_inferred_types",
    "SELECT * REPLACE (CAST(p_size AS INTEGER) AS p_size) FROM part",
)
def csv_with_inferred_types(t):
    path = f"{shared_folder(t.spark)}/part.csv"
    t.part.write.option("header", True).csv(path)
    table = sheets.read_table(t.spark, path)
    return table.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query(
    "s6_syntactic_headers",
    "SELECT race, sum(basic_needs) AS total FROM assessments GROUP BY 1",
)
def syntactic_headers(t):
    raw = t.assessments.withColumnRenamed("basic_needs", "Basic Needs")
    table = headers.syntactic(raw)
    return table.groupBy("race").agg(F.sum("`Basic.Needs`").alias("total"))


@query(
    "s8_without_empty",
    """SELECT race, ethnicity, basic_needs, risk, overall FROM assessments WHERE basic_needs <> 1""",
)
def without_empty(t):
    holes = t.assessments
    kept = F.col("basic_needs") != 1
    return sheets.without_empty(holes.select(*[F.when(kept, F.col(c)).alias(c) for c in holes.columns]))


@query(
    "s9_fill_text",
    "SELECT coalesce(race, 'null') AS race, coalesce(ethnicity, 'null') AS ethnicity, count(*) AS n FROM assessments GROUP BY 1, 2",
)
def fill_text(t):
    return rows_per(sheets.fill_text(t.assessments), "race", "ethnicity")


# --- projections and filters --------------------------------------------------


@query(
    "p1_p2_p3_p4_columns",
    f"""SELECT client_id, veteran AS veteran_flag, CAST(year(birth_date) AS INTEGER) AS birth_year,
      CAST(floor(year(birth_date) / 10) * 10 AS INTEGER) AS decade FROM clients""",
)
def columns(t):
    return (
        t.clients.select("client_id", "birth_date", "veteran", "gender")
        .withColumn("birth_year", F.year("birth_date"))
        .withColumn("decade", (F.floor(F.col("birth_year") / 10) * 10).cast("int"))
        .withColumnRenamed("veteran", "veteran_flag")
        .drop("gender", "birth_date")
    )


@query(
    "p5_p7_program_entries_in_year",
    f"""SELECT household_key, client_id, program_type, CAST(entry_ts AS DATE) AS entry_day FROM entries
      WHERE (program_type = 'Diversion' OR program_type IN {words(L.HOUSING_PROGRAMS)})
      AND CAST(entry_ts AS DATE) >= {ENTRY_YEAR[0]} AND CAST(entry_ts AS DATE) <= {ENTRY_YEAR[1]}""",
)
def program_entries_in_year(t):
    program = F.col("program_type")
    rows = t.entries.filter(
        ((program == L.DIVERSION) | program.isin(list(L.HOUSING_PROGRAMS)))
        & in_window("entry_ts", day(ENTRY_START), day(ENTRY_END))
    )
    return rows.select("household_key", "client_id", "program_type", F.to_date("entry_ts").alias("entry_day"))


@query(
    "p6_excluded_records",
    "SELECT client_id, need_date, need_code FROM calls WHERE client_id <> 26860 AND client_id <> 7",
)
def excluded_records(t):
    kept = sheets.without_records(t.calls, "client_id", [*schemas.TEST_CLIENTS, 7])
    return kept.select("client_id", "need_date", "need_code")


@query(
    "p8_p9_facet",
    "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size BETWEEN 10 AND 30 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')",
)
def facet(t):
    rows = reshape.facet(t.part, "p_size", 10, 30, "p_brand", ["Brand#11", "Brand#22", "Brand#33"])
    return rows.select("p_partkey", "p_size", "p_brand")


@query(
    "a6_facet_choices",
    "SELECT DISTINCT l_returnflag FROM lineitem WHERE l_quantity BETWEEN 1 AND 2",
)
def facet_choices(t):
    return reshape.facet_choices(t.lineitem, "l_quantity", 1, 2, "l_returnflag")


@query(
    "p10_null_tests",
    """SELECT newly_homeless IS NOT NULL AS newly, birth_date IS NULL AS ageless, count(*) AS n
      FROM clients GROUP BY 1, 2""",
)
def null_tests(t):
    marked = t.clients.select(
        F.col("newly_homeless").isNotNull().alias("newly"), F.col("birth_date").isNull().alias("ageless")
    )
    return rows_per(marked, "newly", "ageless")


@query(
    "p11_memberships_on_list",
    """SELECT client_id, household_id, relationship FROM memberships
      WHERE client_id IN (SELECT client_id FROM list_members)""",
)
def memberships_on_list(t):
    ids = by_name_list.list_members(t.clients, START, END).select("client_id")
    return join_on(t.memberships, ids, ["client_id"], "left_semi")


@query(
    "p12_usable_race",
    "SELECT race, ethnicity, count(*) AS n FROM equity GROUP BY 1, 2",
)
def usable_race(t):
    return rows_per(compare.equity_groups(t.assessments), "race", "ethnicity")


@query(
    "p13_p14_p15_p16_comparison_columns",
    """SELECT CASE WHEN race = 'White (HUD)' THEN 'White (HUD)' ELSE 'Other' END AS "group",
      basic_needs, overall, risk FROM assessments""",
)
def comparison_columns(t):
    return equity.comparison(t.assessments, ["White (HUD)"]).rows


# --- scalar functions ---------------------------------------------------------


@query(
    "f1_age",
    f"""SELECT client_id, {years('birth_date', YEAR[1])} AS age_at_year_end,
      {years('birth_date', 'status_date')} AS age_at_status FROM clients""",
)
def age(t):
    return t.clients.select(
        "client_id",
        completed_years("birth_date", day(END)).alias("age_at_year_end"),
        completed_years("birth_date", "status_date").alias("age_at_status"),
    )


@query(
    "f2_date_literal",
    f"SELECT client_id, date_diff('day', status_date, {YEAR[1]}) AS days_to_end FROM clients WHERE status_date >= {YEAR[0]}",
)
def date_literal(t):
    rows = t.clients.filter(F.col("status_date") >= day(START))
    return rows.select("client_id", F.date_diff(day(END), "status_date").cast("long").alias("days_to_end"))


@query(
    "f3_f4_two_way_choice",
    """SELECT veteran, CASE WHEN veteran = 'Yes' THEN 1 WHEN veteran <> 'Yes' THEN 0 END AS strict,
      CASE WHEN veteran = 'Yes' THEN 1 ELSE 0 END AS plain, count(*) AS n FROM clients GROUP BY 1""",
)
def two_way_choice(t):
    yes = F.col("veteran") == "Yes"
    rows = t.clients.select(
        "veteran", strict_if(yes, 1, 0).alias("strict"), F.when(yes, 1).otherwise(0).alias("plain")
    )
    return rows_per(rows, "veteran", "strict", "plain")


@query(
    "f6_f7_f8_membership_and_text",
    """SELECT client_status, coalesce(gender IN ('Male', 'Female'), false) AS binary_gender,
      NOT coalesce(gender IN ('Male', 'Female'), false) AS other_gender, contains(gender, 'Male') AS has_male,
      contains(lower(census_race), 'hud') AS hud_race, replace(client_status, ' ', '') AS status_code, count(*) AS n
      FROM clients GROUP BY 1, 2, 3, 4, 5, 6""",
)
def membership_and_text(t):
    both = within("gender", ["Male", "Female"])
    rows = t.clients.select(
        "client_status",
        both.alias("binary_gender"),
        (~both).alias("other_gender"),
        F.col("gender").contains("Male").alias("has_male"),
        F.lower("census_race").contains("hud").alias("hud_race"),
        F.regexp_replace("client_status", " ", "").alias("status_code"),
    )
    return rows_per(rows, *rows.columns)


@query(
    "f9_client_household",
    """SELECT client_id, coalesce(household_id, concat(CAST(client_id AS VARCHAR), '-C')) AS household, count(*) AS n
      FROM calls GROUP BY 1, 2""",
)
def households_of_clients(t):
    household = F.coalesce("household_id", client_household("client_id")).alias("household")
    return rows_per(t.calls.select("client_id", household), "client_id", "household")


@query(
    "f12_default_value",
    "SELECT client_id, coalesce(score, 0) AS score FROM demographics WHERE client_id IS NOT NULL",
)
def default_value(t):
    return t.demographics.filter(F.col("client_id").isNotNull()).select(
        "client_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


# --- recodes ------------------------------------------------------------------


@query("c1_gender", f"SELECT gender, {gender('gender')} AS report_gender, count(*) AS n FROM clients GROUP BY 1, 2")
def gender_recode(t):
    return rows_per(
        t.clients.select("gender", recode.gender("gender").alias("report_gender")), "gender", "report_gender"
    )


@query(
    "c2_f5_relationship",
    f"SELECT relationship, {relationship('relationship')} AS known, count(*) AS n FROM memberships GROUP BY 1, 2",
)
def relationship_recode(t):
    rows = t.memberships.select("relationship", recode.relationship("relationship").alias("known"))
    return rows_per(rows, "relationship", "known")


@query(
    "c4_race",
    f"""SELECT census_race, ethnicity, race, count(*) AS n FROM (
      SELECT census_race, ethnicity, CASE WHEN split IN {words(L.RACE_LEVELS)} THEN split END AS race FROM (
        SELECT *, CASE WHEN census_race = 'White (HUD)' AND ethnicity <> '{L.HISPANIC}' THEN 'White, Non-Hispanic'
          WHEN NOT (census_race = 'White (HUD)' AND ethnicity <> '{L.HISPANIC}') THEN census_race END AS split FROM list_members))
      GROUP BY 1, 2, 3""",
)
def race_recode(t):
    members = by_name_list.list_members(t.clients, START, END)
    rows = members.select(
        "census_race", "ethnicity", recode.race_level("census_race", "ethnicity").alias("race")
    )
    return rows_per(rows, "census_race", "ethnicity", "race")


@query(
    "c5_bipoc_flag",
    f"""SELECT primary_race, secondary_race, ethnicity,
      {bipoc(['primary_race', 'secondary_race'], 'ethnicity', *CURRENT)} AS current_flag,
      {bipoc(['primary_race', 'secondary_race'], 'ethnicity', *OLD)} AS old_flag,
      {bipoc(['primary_race'], 'ethnicity', *CENSUS)} AS list_flag, count(*) AS n
      FROM caller_demographics GROUP BY 1, 2, 3""",
)
def bipoc_flag(t):
    races = ["primary_race", "secondary_race"]
    rows = t.caller_demographics.select(
        *races,
        "ethnicity",
        recode.bipoc(races, "ethnicity", "current").alias("current_flag"),
        recode.bipoc(races, "ethnicity", "old").alias("old_flag"),
        recode.bipoc(races[:1], "ethnicity", "census").alias("list_flag"),
    )
    return rows_per(rows, *rows.columns)


def _statuses(rows, code, source, number=None):
    inputs = (code, "prior_situation", "fleeing_dv")
    statuses = [
        recode.housing_status(*inputs, variant=v, source=source).alias(f"status_{v}") for v in ("v2", "v3")
    ]
    return rows.groupBy(*inputs, *statuses).agg(F.count(F.lit(1)).alias("n") if number is None else number.alias("n"))


@query(
    "c6_call_status",
    f"""SELECT need_code, prior_situation, fleeing_dv,
      {status('need_code', 'prior_situation', 'fleeing_dv', 'v2', 'calls')} AS status_v2,
      {status('need_code', 'prior_situation', 'fleeing_dv', 'v3', 'calls')} AS status_v3, count(*) AS n
      FROM calls c LEFT JOIN situations s ON c.client_id IS NOT DISTINCT FROM s.client_id AND c.need_date IS NOT DISTINCT FROM s.event_date
      GROUP BY 1, 2, 3""",
)
def call_status(t):
    calls = t.calls.select("client_id", "need_date", "need_code")
    # Identical rows on either side are one row with their number, so keys repeated on both do not multiply.
    situations = with_copies(t.situations.withColumnRenamed("event_date", "need_date"), "times")
    rows = weighted_left_join(calls, situations, ["client_id", "need_date"])
    return _statuses(rows, "need_code", "calls", F.sum(F.col("copies") * F.coalesce("times", F.lit(1))))


@query(
    "c7_callpoint_status",
    f"""SELECT call_type, prior_situation, fleeing_dv,
      {status('call_type', 'prior_situation', 'fleeing_dv', 'v2', 'callpoint')} AS status_v2,
      {status('call_type', 'prior_situation', 'fleeing_dv', 'v3', 'callpoint')} AS status_v3, count(*) AS n
      FROM callpoint GROUP BY 1, 2, 3""",
)
def callpoint_status(t):
    return _statuses(t.callpoint, "call_type", "callpoint")


@query(
    "c11_age_bucket",
    f"SELECT age_at_year_end, {age_bucket('age_at_year_end')} AS bucket, count(*) AS n FROM list_members GROUP BY 1, 2",
)
def age_buckets(t):
    members = by_name_list.list_members(t.clients, START, END)
    rows = members.select("age_at_year_end", recode.age_bucket("age_at_year_end").alias("bucket"))
    return rows_per(rows, "age_at_year_end", "bucket")


@query("c12_active_list", "SELECT client_id, client_status, newly_homeless, status_date FROM list_members")
def active_list(t):
    members = by_name_list.list_members(t.clients, START, END)
    return members.select("client_id", "client_status", "newly_homeless", "status_date")


@query(
    "c13_comparison_group",
    """SELECT race, ethnicity, grp AS equity_group,
      CASE WHEN race IN ('White (HUD)', 'Other') THEN 'Selected Groups' ELSE 'Other' END AS chosen_group, count(*) AS n
      FROM equity GROUP BY 1, 2, 3, 4""",
)
def comparison_group(t):
    rows = compare.equity_groups(t.assessments).select(
        "race",
        "ethnicity",
        F.col("group").alias("equity_group"),
        recode.target_or_other("race", ["White (HUD)", "Other"]).alias("chosen_group"),
    )
    return rows_per(rows, *rows.columns)


# --- sorting ------------------------------------------------------------------


@query("o1_missing_last", "SELECT client_id, score, tie_key FROM demographics")
def missing_last(t):
    return t.demographics.select("client_id", "score", "tie_key").orderBy(down("score"), up("tie_key"))


@query(
    "o3_o4_label_order",
    f"""SELECT bucket, count(*) AS n, CAST(CASE bucket {' '.join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(L.AGE_LEVELS))} END AS INTEGER) AS place
      FROM (SELECT {age_bucket('age_at_year_end')} AS bucket FROM list_members) GROUP BY 1""",
)
def label_order(t):
    members = by_name_list.list_members(t.clients, START, END)
    table = rows_per(members.select(recode.age_bucket("age_at_year_end").alias("bucket")), "bucket")
    place = rank_of("bucket", L.AGE_LEVELS)
    return table.withColumn("place", place).orderBy("place")
