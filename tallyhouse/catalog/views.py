"""Case tables derived from the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

TABLES = ("customer", "orders", "lineitem", "events", "supplier", "part", "nation")

VIEWS = {
    "clients": """
SELECT c_custkey AS client_id,
  CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 97 = 1 THEN DATE '2004-02-29'
    ELSE make_date(CAST(1935 + (c_custkey * 7) % 88 AS INT), CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) END AS birth_date,
  CASE c_custkey % 9 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' WHEN 3 THEN 'Male'
    WHEN 4 THEN 'Transgender, Male to Female' WHEN 5 THEN 'Transgender, Male' WHEN 6 THEN 'non-binary'
    WHEN 7 THEN 'Data not collected' ELSE NULL END AS gender,
  CASE c_nationkey % 8 WHEN 0 THEN 'White (HUD)' WHEN 1 THEN 'Black, African American, or African (HUD)' WHEN 2 THEN 'Other Multi-Racial'
    WHEN 3 THEN 'Asian or Asian American (HUD)' WHEN 4 THEN 'White (HUD)' WHEN 5 THEN 'Other' WHEN 6 THEN 'Client refused (HUD)' ELSE NULL END AS census_race,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'Hispanic/Latin(a)(o)(x) (HUD)' ELSE 'Non-Hispanic/Non-Latin(a)(o)(x) (HUD)' END AS ethnicity,
  CASE c_custkey % 6 WHEN 0 THEN 'Active' WHEN 1 THEN 'Housed' WHEN 2 THEN 'Inactive' WHEN 3 THEN 'Return from Housed' WHEN 4 THEN 'Newly Homeless' ELSE 'Return from Inactive' END AS client_status,
  CASE WHEN c_custkey % 10 = 3 THEN 'Newly Homeless' END AS newly_homeless,
  make_date(CAST(2021 + c_custkey % 3 AS INT), CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) AS status_date,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'Yes' ELSE 'No' END AS veteran
FROM {customer}
""",
    "memberships": """
SELECT DISTINCT o_custkey AS client_id, CASE WHEN o_orderkey % 18 = 0 THEN concat('S', CAST(o_orderkey AS STRING)) ELSE concat('H', CAST(CAST(floor(o_orderkey / 60) AS BIGINT) AS STRING)) END AS household_id,
  CASE CAST(floor(o_orderkey / 9) AS BIGINT) % 12 WHEN 0 THEN 'Self (head of household)' WHEN 1 THEN 'son' WHEN 2 THEN 'wife' WHEN 3 THEN 'sister' WHEN 4 THEN 'mother'
    WHEN 5 THEN 'grandson' WHEN 6 THEN 'cousin' WHEN 7 THEN 'unknown' WHEN 8 THEN 'Self' WHEN 9 THEN 'roommate' WHEN 10 THEN 'Self (head of household)' ELSE NULL END AS relationship
FROM {orders} WHERE o_orderkey % 9 = 0
""",
    "entries": """
SELECT l_orderkey AS household_key, l_orderkey AS group_uid, o_custkey AS client_id, l_suppkey AS provider_id,
  CASE l_linenumber % 7 WHEN 0 THEN 'Emergency Shelter (HUD)' WHEN 1 THEN 'Diversion' WHEN 2 THEN 'Coordinated Entry (HUD)' WHEN 3 THEN 'Transitional housing (HUD)'
    WHEN 4 THEN 'PH - Rapid Re-Housing (HUD)' WHEN 5 THEN 'PH - Permanent Supportive Housing (disability required for entry) (HUD)' ELSE 'Homelessness Prevention (HUD)' END AS program_type,
  l_shipdate AS entry_ts,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate + INTERVAL 45 DAY AS DATE) END AS exit_date,
  CASE l_returnflag WHEN 'R' THEN 'Permanent Situation' WHEN 'A' THEN 'Temporary Situation' ELSE NULL END AS exit_destination,
  CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE CAST(l_partkey % 80 AS INT) END AS age_at_entry
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
""",
    "demographics": """
SELECT o_custkey AS client_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS score, o_orderkey AS tie_key,
  CASE WHEN o_custkey % 9 = 0 THEN 'Yes (HUD)' WHEN o_custkey % 10 = 7 THEN NULL ELSE 'No (HUD)' END AS veteran_status,
  CASE o_custkey % 5 WHEN 0 THEN 'White (HUD)' WHEN 1 THEN 'Black, African American, or African (HUD)' WHEN 2 THEN NULL WHEN 3 THEN 'White (HUD)' ELSE 'Other Multi-Racial' END AS primary_race,
  CASE WHEN o_custkey % 7 = 0 THEN 'Asian or Asian American (HUD)' END AS secondary_race,
  CASE WHEN o_custkey % 8 = 0 THEN 'Hispanic/Latin(a)(o)(x) (HUD)' WHEN o_custkey % 8 = 1 THEN NULL ELSE 'Non-Hispanic/Non-Latin(a)(o)(x) (HUD)' END AS ethnicity
FROM {orders}
""",
    "providers": """
SELECT s_suppkey AS provider_id, s_nationkey AS agency FROM {supplier} WHERE s_suppkey % 10 <> 4
UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 25 FROM {supplier} WHERE s_suppkey % 25 = 0
""",
    "calls": """
SELECT CASE WHEN event_id % 4 = 1 THEN NULL ELSE concat('N', CAST(CAST(floor(user_id / 3) AS BIGINT) AS STRING)) END AS household_id,
  user_id AS client_id, CAST(ts AS DATE) AS need_date,
  CASE event_type WHEN 'error' THEN 'Coordinated Entry (all literally homeless)' WHEN 'view' THEN 'Rent Payment Assistance' WHEN 'click' THEN 'Emergency Shelter'
    WHEN 'signup' THEN 'Prevention - ERAP (CARES money)' ELSE 'Animal Shelters' END AS need_code,
  CASE WHEN user_id % 23 = 0 AND event_id % 2 = 0 THEN NULL WHEN user_id % 9 = 0 THEN 'Yes (HUD)' ELSE 'No (HUD)' END AS veteran_status,
  CASE WHEN user_id % 50 = 49 THEN NULL ELSE concat('P', CAST(user_id % 120 AS STRING)) END AS name_string,
  CASE WHEN user_id % 19 = 0 THEN NULL ELSE CAST((user_id * 7) % 80 AS INT) END AS supplied_age
FROM {events} WHERE event_id % 3 <> 0
""",
    "situations": """
SELECT user_id AS client_id, CAST(ts AS DATE) AS event_date,
  CASE WHEN event_id % 4 = 0 THEN 'Safe Haven (HUD)' ELSE 'Group home (not foster care)' END AS prior_situation,
  CASE WHEN event_id % 7 = 0 THEN 'Yes' WHEN event_id % 7 = 1 THEN NULL ELSE 'No' END AS fleeing_dv
FROM {events} WHERE event_id % 3 = 1
""",
    "caller_demographics": """
SELECT DISTINCT user_id AS client_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE make_date(CAST(1940 + user_id % 120 AS INT) - CAST(60 * floor((user_id % 120) / 75) AS INT), CAST(1 + user_id % 12 AS INT), CAST(1 + (user_id % 120) % 28 AS INT)) END AS birth_date,
  CASE user_id % 5 WHEN 0 THEN 'White (HUD)' WHEN 1 THEN 'Black, African American, or African (HUD)' WHEN 2 THEN NULL WHEN 3 THEN 'White (HUD)' ELSE 'Asian (HUD)' END AS primary_race,
  CASE WHEN user_id % 11 = 0 THEN 'Other' END AS secondary_race,
  CASE WHEN user_id % 8 = 0 THEN 'Hispanic/Latin(a)(o)(x) (HUD)' WHEN user_id % 8 = 1 THEN NULL ELSE 'Non-Hispanic/Non-Latin(a)(o)(x) (HUD)' END AS ethnicity
FROM {events}
""",
    "callpoint": """
SELECT CASE WHEN event_id % 2 = 0 THEN user_id ELSE -(1 + event_id) END AS client_id, CAST(ts AS DATE) AS call_date,
  CASE event_type WHEN 'error' THEN 'Coordinated Entry (all literally homeless)' WHEN 'signup' THEN 'Information Only (not literally homeless or at-risk)' ELSE 'Other' END AS call_type,
  CASE WHEN user_id % 9 = 0 THEN 'Yes (HUD)' ELSE 'No (HUD)' END AS veteran_status,
  CASE WHEN event_id % 33 = 0 THEN NULL ELSE concat('P', CAST(user_id % 120 AS STRING)) END AS name_string,
  CASE WHEN user_id % 7 = 0 AND event_id % 2 = 0 THEN NULL ELSE make_date(CAST(1940 + user_id % 120 AS INT) - CAST(60 * floor((user_id % 120) / 75) AS INT), CAST(1 + user_id % 12 AS INT), CAST(1 + (user_id % 120) % 28 AS INT)) END AS birth_date,
  CASE CAST(floor(event_id / 3) AS BIGINT) % 6 WHEN 3 THEN 'Homeless/on the Street' ELSE NULL END AS prior_situation,
  CASE WHEN event_id % 7 = 0 THEN 'Yes' ELSE 'No' END AS fleeing_dv,
  CASE user_id % 5 WHEN 0 THEN 'White (HUD)' WHEN 1 THEN 'Black, African American, or African (HUD)' WHEN 2 THEN NULL WHEN 3 THEN 'White (HUD)' ELSE 'Asian (HUD)' END AS primary_race,
  CASE WHEN user_id % 11 = 0 THEN 'Other' END AS secondary_race,
  CASE WHEN user_id % 8 = 0 THEN 'Hispanic/Latin(a)(o)(x) (HUD)' WHEN user_id % 8 = 1 THEN NULL ELSE 'Non-Hispanic/Non-Latin(a)(o)(x) (HUD)' END AS ethnicity
FROM {events} WHERE event_id % 3 = 0
""",
    "assessments": """
SELECT CASE l_returnflag WHEN 'R' THEN 'White (HUD)' WHEN 'A' THEN 'Black, African American, or African (HUD)' ELSE 'Client refused (HUD)' END AS race,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 3 = 0 THEN 'Hispanic/Latin(a)(o)(x) (HUD)' ELSE 'Non-Hispanic/Non-Latin(a)(o)(x) (HUD)' END AS ethnicity,
  CAST(l_quantity AS DOUBLE) AS basic_needs, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_discount * 100 END AS risk,
  l_extendedprice AS overall, CAST(NULL AS DOUBLE) AS unused
FROM {lineitem}
""",
}
