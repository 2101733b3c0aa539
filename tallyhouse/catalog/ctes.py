"""Common table expressions of the checking SQL.

They follow the reports step by step (joins and windows over all rows), not the
shapes the Spark operators use.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import labels as L
from .views import TABLES, VIEWS

YEAR = ("DATE '2022-01-01'", "DATE '2022-12-31'")
ENTRY_YEAR = ("DATE '2000-01-01'", "DATE '2000-12-31'")


def words(values: Iterable[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def years(born: str, at: str) -> str:
    def stamp(d: str) -> str:
        return f"(year({d}) * 10000 + month({d}) * 100 + day({d}))"

    return f"CAST(floor(({stamp(at)} - {stamp(born)}) / 10000) AS INTEGER)"


def gender(c: str) -> str:
    return f"""CASE WHEN contains({c}, 'Transgender') AND contains({c}, 'Female') THEN 'Trans Woman'
      WHEN contains({c}, 'Transgender') AND contains({c}, 'Male') THEN 'Trans Man'
      WHEN contains({c}, 'non-binary') OR (contains({c}, 'Female') AND contains({c}, 'Male')) THEN 'Non Binary'
      ELSE {c} END"""


def relationship(c: str) -> str:
    whens = " ".join(
        f"WHEN {c} IN {words(codes)} THEN '{label}'" for label, codes in L.RELATIONSHIPS.items()
    )
    return f"CASE {whens} WHEN {c} IS NULL THEN 'Unknown' ELSE {c} END"


def age_bucket(c: str) -> str:
    whens = " ".join(
        f"WHEN {c} <= {top} THEN '{label}'" for label, top in L.AGE_BUCKETS if top is not None
    )
    return f"CASE {whens} WHEN {c} >= 70 THEN '70+' ELSE 'Unknown' END"


def bipoc(races: Iterable[str], ethnicity: str, listed: Iterable[str], hispanic: Iterable[str]) -> str:
    tests = [f"{r} IN {words(listed)}" for r in races] + [f"{ethnicity} IN {words(hispanic)}"]
    return f"CASE WHEN {' OR '.join(tests)} THEN 1 ELSE 0 END"


CURRENT = (L.BIPOC_RACES, [L.HISPANIC])
OLD = (L.BIPOC_RACES_OLD, [L.HISPANIC_OLD])
CENSUS = (L.BIPOC_CENSUS_RACES, [L.HISPANIC, L.HISPANIC_OLD])


def status(code: str, situation: str, fleeing: str, variant: str, source: str) -> str:
    dv = f" OR {fleeing} = 'Yes'" if variant == "v2" else ""
    parts = [
        f"WHEN {code} IN {words(L.LITERAL_CODES)}{dv} OR {situation} IN {words(L.LITERAL_SITUATIONS)} THEN 'Literally Homeless'",
        f"WHEN {code} IN {words(L.HOUSED_CODES)} OR {situation} IN {words(L.HOUSED_SITUATIONS)} THEN 'Not Literally Homeless'",
    ]
    if source == "calls" and variant == "v2":
        parts.append(f"WHEN {code} IN {words(L.PROBABLY_LITERAL_CODES)} THEN 'Literally Homeless'")
    if source == "calls":
        parts.append(f"WHEN {code} IN {words(L.PROBABLY_HOUSED_CODES)} THEN 'Not Literally Homeless'")
    rest = "Unknown" if variant == "v2" else "Not Literally Homeless"
    return f"CASE {' '.join(parts)} ELSE '{rest}' END"


def strict(condition: str, yes: str, no: str) -> str:
    return f"CASE WHEN {condition} THEN {yes} WHEN NOT ({condition}) THEN {no} END"


def enriched(variant: str) -> str:
    vocabulary = OLD if variant == "v2" else CURRENT
    return f"""
SELECT c.household_id, c.client_id, c.need_date AS call_date, c.veteran_status, c.name_string, d.birth_date,
  {status('c.need_code', 's.prior_situation', 's.fleeing_dv', variant, 'calls')} AS housed_status,
  {bipoc(['d.primary_race', 'd.secondary_race'], 'd.ethnicity', *vocabulary)} AS bipoc,
  CASE WHEN c.need_code IN {words(L.SHELTER_CODES)} THEN 1 ELSE 0 END AS asked_shelter
FROM calls c
LEFT JOIN situations s ON c.client_id IS NOT DISTINCT FROM s.client_id AND c.need_date IS NOT DISTINCT FROM s.event_date
LEFT JOIN caller_demographics d ON c.client_id IS NOT DISTINCT FROM d.client_id
WHERE c.client_id <> 26860
"""


def resolved(source: str) -> str:
    return f"""
SELECT household_id, client_id, call_date, name_string, birth_date, housed_status,
  max(bipoc) OVER c AS bipoc,
  max(coalesce(asked_shelter, 0)) OVER c AS asked_shelter,
  CASE WHEN count(veteran_status) OVER c < count(*) OVER c THEN NULL
    WHEN max(CASE WHEN veteran_status = 'Yes (HUD)' THEN 1 ELSE 0 END) OVER c = 1 THEN 'Yes' ELSE 'No' END AS veteran,
  {years('birth_date', 'call_date')} AS age
FROM (
  SELECT coalesce(household_id, concat(CAST(resolved_id AS VARCHAR), '-C')) AS household_id, resolved_id AS client_id,
    call_date, name_string, born AS birth_date, housed_status, bipoc, asked_shelter, veteran_status
  FROM (
    SELECT *, coalesce(min(CASE WHEN client_id > 0 THEN client_id END) OVER p, max(client_id) OVER p) AS resolved_id
    FROM (SELECT *, coalesce(birth_date, max(birth_date) OVER (PARTITION BY name_string)) AS born FROM {source})
    WINDOW p AS (PARTITION BY name_string, born)
  )
)
WINDOW c AS (PARTITION BY client_id)
"""


def base(source: str, variant: str) -> str:
    day = ", day_status" if variant == "v2" else ""
    ties = "household_id, housed_status" if variant == "v2" else "housed_status, household_id"
    return f"""
SELECT household_id, client_id, housed_status, bipoc, CASE WHEN asked_shelter = 1 THEN 'Yes' ELSE 'No' END AS asked_shelter,
  veteran, age{day}, household_size, max_age, min_age
FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY household_size DESC, {ties}, bipoc, asked_shelter,
    veteran NULLS LAST, age NULLS LAST{day}) AS place
  FROM (
    SELECT *, count(*) OVER (PARTITION BY household_id, housed_status) AS household_size,
      max(age) OVER (PARTITION BY household_id) AS max_age, min(age) OVER (PARTITION BY household_id) AS min_age
    FROM (SELECT DISTINCT household_id, client_id, housed_status, bipoc, asked_shelter, veteran, age{day} FROM {source})
  )
)
WHERE place = 1
"""


def counts(source: str, metrics: Iterable[tuple[str, str, str, str]], report: str | None = None) -> str:
    """One distinct count after another: (population, metric, key, condition)."""
    head = f"'{report}' AS report, " if report else ""
    return "\nUNION ALL\n".join(
        f"SELECT {head}{text(p)} AS population, {text(m)} AS metric, count(*) AS value "
        f"FROM (SELECT DISTINCT {key} FROM {source} WHERE {where})"
        for p, m, key, where in metrics
    )


CTES = {name: sql.format(**{t: t for t in TABLES}) for name, sql in VIEWS.items()}

CTES["list_members"] = f"""
SELECT * REPLACE ({gender('gender')} AS gender,
    {strict("census_race = 'Other Multi-Racial'", "'Two or More Races'", 'census_race')} AS census_race),
  {years('birth_date', YEAR[1])} AS age_at_year_end
FROM clients
WHERE newly_homeless = 'Newly Homeless' OR client_status IN {words(L.ACTIVE_STATUSES)}
  OR (client_status = 'Housed' AND status_date >= {YEAR[0]} AND status_date <= {YEAR[1]})
"""
CTES["known_memberships"] = f"""
SELECT client_id, household_id, {relationship('relationship')} AS relationship FROM memberships
"""


def _flag(aggregate: str, condition: str) -> str:
    return (
        "CASE WHEN count(relationship) OVER h < count(*) OVER h THEN NULL "
        f"ELSE {aggregate}(CASE WHEN {condition} THEN 1 ELSE 0 END) OVER h END"
    )


CTES["household_members"] = f"""
SELECT c.client_id, c.gender, c.age_at_year_end, m.household_id, m.relationship,
  count(*) OVER h AS household_size, max(age_at_year_end) OVER h AS max_household_age, min(age_at_year_end) OVER h AS min_household_age,
  min(CASE WHEN relationship IN ('Self', 'Partner') THEN 1 ELSE 0 END) OVER h AS self_partner_only,
  {_flag('max', "relationship = 'Child'")} AS has_child, {_flag('max', "relationship = 'Parent'")} AS has_parent,
  {_flag('min', "relationship = 'Self'")} AS all_heads,
  max(CASE WHEN relationship IN ('Grandchild', 'Grandparent') THEN 1 ELSE 0 END) OVER h AS spans_generations,
  max(CASE WHEN relationship IN ('Sibling', 'Other Relative') THEN 1 ELSE 0 END) OVER h AS has_other_family
FROM list_members c LEFT JOIN known_memberships m ON c.client_id IS NOT DISTINCT FROM m.client_id
WINDOW h AS (PARTITION BY m.household_id)
"""
CTES["assigned"] = """
SELECT * EXCLUDE (place, age_at_year_end) FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY household_size DESC, household_id NULLS LAST,
    relationship NULLS LAST, gender NULLS LAST, age_at_year_end NULLS LAST) AS place
  FROM household_members)
WHERE place = 1
"""


def household_type(unknown_age: str = "infinite") -> str:
    youngest = "coalesce(CAST(min_household_age AS DOUBLE), 1e9)" if unknown_age == "infinite" else "min_household_age"
    descent = "(has_child = 1 OR has_parent = 1 OR spans_generations = 1)"
    return f"""CASE WHEN {youngest} < 18 THEN 'Family With Children'
    WHEN household_size = 1 AND gender IN ('Trans Woman', 'Female') THEN 'Single Female'
    WHEN household_size = 1 AND gender IN ('Trans Man', 'Male') THEN 'Single Male'
    WHEN household_size = 1 AND gender IN ('Client refused', 'Data not collected') OR gender IS NULL THEN 'Single Person - Gender Unknown'
    WHEN household_size = 1 AND gender = 'Non Binary' THEN 'Single Non-Binary Person'
    WHEN self_partner_only = 1 THEN 'Couple'
    WHEN {youngest} >= 18 AND {descent} THEN 'Household with Adult Child/ren'
    WHEN {youngest} IS NULL AND {descent} THEN 'Household with Child/ren, Age Unknown'
    WHEN has_other_family = 1 THEN 'Other Familial Relationship'
    WHEN {youngest} >= 18 THEN 'Adults Only, Relationship Unknown'
    ELSE 'Cannot Determine' END"""


CTES["typed"] = f"""
SELECT *, {household_type()} AS household_type, {household_type('null')} AS household_type_live FROM assigned
"""
CTES["roster"] = """
SELECT l.*, a.household_id, a.household_size, a.max_household_age, a.min_household_age
FROM list_members l LEFT JOIN assigned a ON l.client_id IS NOT DISTINCT FROM a.client_id
"""

CTES["enriched_v3"] = enriched("v3")
CTES["enriched_v2"] = enriched("v2")
for _variant, _vocabulary in (("v3", CURRENT), ("v2", OLD)):
    CTES[f"callpoint_{_variant}"] = f"""
SELECT client_id, call_date, veteran_status, name_string, birth_date,
  {status('call_type', 'prior_situation', 'fleeing_dv', _variant, 'callpoint')} AS housed_status,
  {bipoc(['primary_race', 'secondary_race'], 'ethnicity', *_vocabulary)} AS bipoc
FROM callpoint WHERE client_id <> 26860 AND name_string IS NOT NULL
"""

_CALL_KEYS = ("client_id", "call_date", "veteran_status", "name_string", "birth_date", "housed_status", "bipoc")
CTES["merged"] = f"""
SELECT DISTINCT e.household_id, {', '.join(f'coalesce(e.{k}, c.{k}) AS {k}' for k in _CALL_KEYS)}, e.asked_shelter
FROM enriched_v3 e FULL JOIN callpoint_v3 c ON {' AND '.join(f'e.{k} IS NOT DISTINCT FROM c.{k}' for k in _CALL_KEYS)}
"""
CTES["resolved_v3"] = resolved("merged")
CTES["base_v3"] = base("resolved_v3", "v3")
CTES["resolved_v2"] = resolved("enriched_v2")
CTES["with_day_v2"] = """
SELECT *, CASE max(CASE housed_status WHEN 'Literally Homeless' THEN 2 WHEN 'Not Literally Homeless' THEN 1 ELSE 0 END)
    OVER (PARTITION BY household_id, call_date)
  WHEN 2 THEN 'Literally Homeless' WHEN 1 THEN 'Not Literally Homeless' ELSE 'Unknown' END AS day_status
FROM resolved_v2
"""
CTES["base_v2"] = base("with_day_v2", "v2")
CTES["flagged_v1"] = f"""
SELECT household_id, client_id, supplied_age AS age,
  CASE WHEN max(CASE WHEN need_code IN {words(L.SHELTER_CODES)} THEN 1 ELSE 0 END) OVER c = 1 THEN 'Yes' ELSE 'No' END AS asked_shelter,
  CASE WHEN count(veteran_status) OVER c < count(*) OVER c THEN NULL
    WHEN max(CASE WHEN veteran_status = 'Yes (HUD)' THEN 1 ELSE 0 END) OVER c = 1 THEN 'Yes' ELSE 'No' END AS veteran
FROM calls WINDOW c AS (PARTITION BY client_id)
"""
CTES["base_v1"] = """
SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY household_size DESC, household_id NULLS LAST, age NULLS LAST) AS place
  FROM (
    SELECT *, count(*) OVER h AS household_size,
      CASE WHEN count(age) OVER h = count(*) OVER h THEN max(age) OVER h END AS max_age,
      CASE WHEN count(age) OVER h = count(*) OVER h THEN min(age) OVER h END AS min_age
    FROM (SELECT DISTINCT * FROM flagged_v1) WINDOW h AS (PARTITION BY household_id)
  )
)
WHERE place = 1
"""

CTES["aged_entries"] = """
SELECT *, CASE WHEN count(age_at_entry) OVER g = count(*) OVER g THEN max(age_at_entry) OVER g END AS max_entry_age,
  CASE WHEN count(age_at_entry) OVER g = count(*) OVER g THEN min(age_at_entry) OVER g END AS min_entry_age
FROM entries WINDOW g AS (PARTITION BY group_uid)
"""
CTES["best_demographics"] = """
SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY score DESC NULLS LAST, tie_key) AS place FROM demographics)
WHERE place = 1
"""
CTES["veteran_entries"] = """
SELECT e.* FROM aged_entries e JOIN best_demographics d ON e.client_id IS NOT DISTINCT FROM d.client_id
WHERE d.veteran_status = 'Yes (HUD)'
"""
CTES["bipoc_entries"] = f"""
SELECT e.* FROM aged_entries e JOIN best_demographics d ON e.client_id IS NOT DISTINCT FROM d.client_id
WHERE e.age_at_entry >= 18 AND {bipoc(['d.primary_race', 'd.secondary_race'], 'd.ethnicity', *CURRENT)} = 1
"""
CTES["housing_entries"] = f"""
SELECT e.*, p.agency FROM entries e
LEFT JOIN (SELECT DISTINCT agency, provider_id FROM providers) p ON e.provider_id IS NOT DISTINCT FROM p.provider_id
WHERE e.program_type IN {words(L.HOUSING_PROGRAMS)} AND CAST(e.entry_ts AS DATE) BETWEEN {ENTRY_YEAR[0]} AND {ENTRY_YEAR[1]}
"""

# --- assessments --------------------------------------------------------------

CTES["equity"] = """
SELECT *, CASE WHEN race = 'White (HUD)' AND ethnicity <> 'Hispanic/Latin(a)(o)(x) (HUD)' THEN 'White'
    WHEN NOT (race = 'White (HUD)' AND ethnicity <> 'Hispanic/Latin(a)(o)(x) (HUD)') THEN 'BIPOC' END AS grp
FROM assessments
WHERE ethnicity = 'Hispanic/Latin(a)(o)(x) (HUD)' OR (NOT contains(race, 'Client') AND NOT contains(race, 'Data'))
"""
CTES["equity_long"] = """
SELECT grp, 'basic_needs' AS variable, basic_needs AS val FROM equity
UNION ALL SELECT grp, 'overall', overall FROM equity
UNION ALL SELECT grp, 'risk', risk FROM equity
UNION ALL SELECT grp, 'unused', unused FROM equity
"""
CTES["equity_needs"] = "SELECT grp, 'basic_needs' AS variable, basic_needs AS val FROM equity"
CTES["equity_scaled"] = """
SELECT grp, 'basic_needs' AS variable, (basic_needs - (SELECT min(basic_needs) FROM equity))
    / nullif((SELECT max(basic_needs) - min(basic_needs) FROM equity), 0) AS val FROM equity
UNION ALL SELECT grp, 'overall', (overall - (SELECT min(overall) FROM equity))
    / nullif((SELECT max(overall) - min(overall) FROM equity), 0) FROM equity
"""
# Target group Hispanic against all others, three factors (one column is empty).
CTES["compared"] = """
SELECT CASE WHEN ethnicity = 'Hispanic/Latin(a)(o)(x) (HUD)' THEN 'Hispanic/Latin(a)(o)(x) (HUD)' ELSE 'Other' END AS grp,
  basic_needs, overall, risk FROM assessments
"""
CTES["compared_long"] = """
SELECT grp, 'basic_needs' AS variable, basic_needs AS val FROM compared
UNION ALL SELECT grp, 'overall', overall FROM compared
UNION ALL SELECT grp, 'risk', risk FROM compared
"""
CTES["compared_scaled"] = """
SELECT grp, variable, (val - lo) / nullif(hi - lo, 0) AS val
FROM compared_long JOIN (SELECT variable AS v, min(val) AS lo, max(val) AS hi FROM compared_long GROUP BY 1) ON variable = v
WHERE val IS NOT NULL
"""


def two_sided(tests: str) -> str:
    """Adds the two-sided p-value: one minus twice a Simpson sum of the t density."""
    return f"""
SELECT t.*, s.p FROM {tests} t JOIN (
  SELECT variable AS tested, 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
    * pow(1 + pow(abs(statistic) * i / 4000, 2) / df, -(df + 1) / 2)) * any_value(abs(statistic)) / 4000 / 3 AS p
  FROM {tests}, range(4001) g(i) GROUP BY variable
) s ON t.variable = s.tested
"""


def moments(source: str, first: str, second: str) -> str:
    parts = []
    for i, g in enumerate((first, second), start=1):
        parts += [
            f"count(val) FILTER (grp = '{g}') AS n{i}",
            f"avg(val) FILTER (grp = '{g}') AS mean{i}",
            f"var_samp(val) FILTER (grp = '{g}') AS var{i}",
        ]
    return f"SELECT variable, {', '.join(parts)} FROM {source} GROUP BY variable HAVING count(val) > 0"


def welch(source: str) -> str:
    return f"""
SELECT variable, mean1 - mean2 AS estimate, mean1 AS estimate1, mean2 AS estimate2, n1, n2,
  (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS statistic, sqrt(var1 / n1 + var2 / n2) AS err,
  pow(var1 / n1 + var2 / n2, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1)) AS df
FROM ({moments(source, 'BIPOC', 'White')})
"""


CTES["welch_raw"] = welch("equity_long")
CTES["welch_scaled"] = welch("equity_scaled")
CTES["welch_raw_p"] = two_sided("welch_raw")
CTES["welch_scaled_p"] = two_sided("welch_scaled")
CTES["tukey"] = f"""
SELECT variable, mean2 - mean1 AS difference, CAST(n1 + n2 - 2 AS DOUBLE) AS df,
  (mean2 - mean1) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS statistic
FROM ({moments('compared_long', L.HISPANIC, 'Other')})
"""
CTES["tukey_p"] = two_sided("tukey")
