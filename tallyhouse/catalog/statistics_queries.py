"""Queries over reshaping, two-group comparison and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import compare, distributions, reshape
from ..operators.keyed import distinct_union
from ..plans import equity, significance
from .registry import query

FACTORS = ("basic_needs", "overall", "risk")
TARGET = [L.HISPANIC]
GROUPS = (L.HISPANIC, "Other")


def _comparison(t) -> equity.Comparison:
    return equity.comparison(t.assessments, TARGET, split="ethnicity", factors=FACTORS)


def _raw_long(t):
    return reshape.to_long(_comparison(t).rows, "group", FACTORS)


def _rounded(frame, digits: int = 6, **other: int):
    return frame.select(
        *[
            F.round(f.name, other.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in frame.schema.fields
        ]
    )


# --- reshape ------------------------------------------------------------------


@query(
    "k1_wide_to_long",
    """SELECT p_brand, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part
      UNION ALL SELECT p_brand, 'p_retailprice', p_retailprice FROM part""",
)
def wide_to_long(t):
    return reshape.to_long(t.part, "p_brand", ["p_size", "p_retailprice"])


@query(
    "k2_long_to_wide",
    """SELECT grp AS "group", round(avg(basic_needs), 6) AS basic_needs, round(avg(overall), 6) AS overall, round(avg(risk), 6) AS risk
      FROM compared GROUP BY 1""",
)
def long_to_wide(t):
    means = compare.moments(_comparison(t).rows, "group", FACTORS).select(
        "group", "variable", F.col("mean").alias("value")
    )
    return _rounded(reshape.to_wide(means, "group", FACTORS))


@query(
    "j7_tests_side_by_side",
    "SELECT 'P Value' AS \"group\", "
    + ", ".join(f"max(CASE WHEN variable = '{f}' THEN round(p, 8) END) AS {f}" for f in FACTORS)
    + " FROM tukey_p",
)
def tests_side_by_side(t):
    tests = _comparison(t).tests().select(F.lit(compare.P_ROW).alias("group"), "variable", "p_value")
    return _rounded(reshape.to_wide(tests, "group", FACTORS, "p_value"), 8)


@query(
    "u1_distinct_union",
    "SELECT need_code AS code, veteran_status FROM calls UNION SELECT call_type, veteran_status FROM callpoint",
)
def union_of_codes(t):
    calls = t.calls.select(F.col("need_code").alias("code"), "veteran_status")
    return distinct_union(calls, t.callpoint.select(F.col("call_type").alias("code"), "veteran_status"))


# --- group moments and scaling ------------------------------------------------


@query(
    "a7_group_means",
    """SELECT grp AS "group", variable, count(val) AS n, round(avg(val), 6) AS mean FROM compared_long GROUP BY 1, 2""",
)
def group_means(t):
    rows = compare.moments(_comparison(t).rows, "group", FACTORS)
    return _rounded(rows.select("group", "variable", "n", "mean"))


def _scaled_sql(strict: bool) -> str:
    def share(f: str) -> str:
        scaled = f"({f} - min({f}) OVER ()) / nullif(max({f}) OVER () - min({f}) OVER (), 0)"
        return f"round(CASE WHEN count({f}) OVER () = count(*) OVER () THEN {scaled} END, 6)" if strict else f"round({scaled}, 6)"

    shares = ", ".join(f"{share(f)} AS {f}" for f in FACTORS)
    return f"""SELECT "group", {', '.join(FACTORS)}, count(*) AS n FROM (SELECT grp AS "group", {shares} FROM compared) GROUP BY ALL"""


def _scaled_rows(t, strict: bool):
    rows = _rounded(reshape.scaled(_comparison(t).rows, FACTORS, strict=strict).select("group", *FACTORS))
    return rows.groupBy("group", *FACTORS).agg(F.count(F.lit(1)).alias("n"))


@query("a11_f11_scaled", _scaled_sql(strict=False))
def scaled(t):
    return _scaled_rows(t, strict=False)


@query("f10_scaled_strict", _scaled_sql(strict=True))
def scaled_strict(t):
    return _scaled_rows(t, strict=True)


# --- tests --------------------------------------------------------------------

# The normal quantile and the usual expansion of the t quantile around it.
_REACH = """err * (z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df)
  + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(df, 3)))"""


def _welch_sql(source: str) -> str:
    return f"""
SELECT variable, round(estimate, 6) AS estimate, round(estimate1, 6) AS estimate1, round(estimate2, 6) AS estimate2,
  'BIPOC' AS group1, 'White' AS group2, n1, n2, round(statistic, 6) AS statistic, round(df, 4) AS df, round(p, 8) AS p,
  round(estimate - {_REACH}, 6) AS conf_low, round(estimate + {_REACH}, 6) AS conf_high, round(p, 8) AS p_adjusted,
  CASE WHEN p <= 0.0001 THEN '****' WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS p_signif
FROM (SELECT *, 1.959963984540054 AS z FROM {source})
"""


@query("t1_t2_t3_welch", _welch_sql("welch_raw_p"))
def welch(t):
    return _rounded(significance.tests(t.assessments), 6, p=8, p_adjusted=8, df=4)


@query("t1_welch_scaled", _welch_sql("welch_scaled_p"))
def welch_scaled(t):
    return _rounded(significance.tests(t.assessments, normalised=True), 6, p=8, p_adjusted=8, df=4)


@query(
    "t4_tukey",
    "SELECT variable, round(difference, 6) AS difference, round(statistic, 6) AS statistic, df, round(p, 8) AS p_value FROM tukey_p",
)
def tukey(t):
    return _rounded(_comparison(t).tests(), 6, p_value=8)


@query(
    "t5_averages",
    """SELECT grp AS "group", round(avg(basic_needs), 6) AS basic_needs, round(avg(overall), 6) AS overall, round(avg(risk), 6) AS risk
      FROM compared GROUP BY 1 UNION ALL SELECT 'P Value', """
    + ", ".join(f"max(CASE WHEN variable = '{f}' THEN round(p, 6) END)" for f in FACTORS)
    + " FROM tukey_p",
)
def averages(t):
    return _rounded(_comparison(t).averages())


@query(
    "t6_bands",
    """SELECT variable, round(p, 8) AS p_value, CASE WHEN p <= 0.05 THEN 'green' WHEN p <= 0.2 THEN 'yellow' ELSE 'white' END AS band
      FROM tukey_p""",
)
def bands(t):
    return _rounded(_comparison(t).bands(), 8)


# --- distributions ------------------------------------------------------------


@query(
    "t7_distributions",
    """SELECT grp AS "group", variable, round(val, 9) AS value, count(*) AS n,
      CAST(CASE variable WHEN 'basic_needs' THEN 1 WHEN 'overall' THEN 2 ELSE 3 END AS INTEGER) AS place
      FROM compared_scaled GROUP BY 1, 2, 3""",
)
def scaled_distributions(t):
    rows = _comparison(t).distributions()
    return _rounded(rows, 9).groupBy("group", "variable", "value", "place").agg(F.count(F.lit(1)).alias("n"))


_QUARTILES = """round(quantile_cont(val, 0.25), 6) AS q1, round(quantile_cont(val, 0.5), 6) AS median,
  round(quantile_cont(val, 0.75), 6) AS q3"""


@query(
    "t8_quartiles",
    f'SELECT grp AS "group", variable, {_QUARTILES} FROM compared_scaled GROUP BY 1, 2',
)
def quartiles(t):
    return _rounded(_comparison(t).medians())


_FENCED = """
(SELECT c.grp, c.variable, val, q1, median, q3, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence
 FROM compared_long c JOIN (
   SELECT grp, variable, quantile_cont(val, 0.25) AS q1, quantile_cont(val, 0.5) AS median, quantile_cont(val, 0.75) AS q3
   FROM compared_long WHERE val IS NOT NULL GROUP BY 1, 2) q ON c.grp = q.grp AND c.variable = q.variable
 WHERE val IS NOT NULL)
"""


@query(
    "t9_boxes",
    f"""SELECT grp AS "group", variable, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      round(least(q1, min(val) FILTER (val BETWEEN low_fence AND high_fence)), 6) AS whisker_low,
      round(greatest(q3, max(val) FILTER (val BETWEEN low_fence AND high_fence)), 6) AS whisker_high,
      count(*) FILTER (val NOT BETWEEN low_fence AND high_fence) AS outliers FROM {_FENCED} GROUP BY grp, variable, q1, median, q3""",
)
def boxes(t):
    return _rounded(distributions.box_table(_raw_long(t), GROUPS))


@query(
    "t9_outliers",
    f"""SELECT grp AS "group", variable, val AS value, count(*) AS n FROM {_FENCED}
      WHERE val < low_fence OR val > high_fence GROUP BY grp, variable, val""",
)
def outliers(t):
    return distributions.outlier_values(_raw_long(t), GROUPS)


@query(
    "t9_event_outliers",
    """SELECT e.event_type AS "group", 'value' AS variable, value, count(*) AS n FROM events e JOIN (
        SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) q
        ON e.event_type = q.event_type
      WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3""",
)
def event_outliers(t):
    """A column with a long tail, so that there are outliers."""
    long = reshape.to_long(t.events, "event_type", ["value"]).withColumnRenamed("event_type", "group")
    return distributions.outlier_values(long, ("click", "error", "purchase", "signup", "view"))


@query(
    "t10_histogram",
    """SELECT grp AS "group", CAST(ceil(basic_needs - 0.5) AS BIGINT) AS bin, count(*) AS n FROM equity
      WHERE basic_needs IS NOT NULL GROUP BY 1, 2""",
)
def histogram(t):
    return significance.histogram(t.assessments, "basic_needs")


def _density_sql(source: str, cut: float, shared: bool) -> str:
    per_variable = "PARTITION BY variable"
    joint = (
        f"avg(own_bw) OVER ({per_variable}) AS bw, min(own_low) OVER ({per_variable}) AS low, max(own_high) OVER ({per_variable}) AS high"
        if shared
        else "own_bw AS bw, own_low AS low, own_high AS high"
    )
    return f"""
, widths AS (
  SELECT grp, variable, n, {joint} FROM (
    SELECT grp, variable, count(*) AS n, min(val) AS own_low, max(val) AS own_high,
      0.9 * least(stddev_samp(val), (quantile_cont(val, 0.75) - quantile_cont(val, 0.25)) / 1.34) * pow(count(*), -0.2) AS own_bw
    FROM {source} WHERE val IS NOT NULL GROUP BY 1, 2)
), nodes AS (
  SELECT grp, variable, CAST(floor(place) AS BIGINT) AS node, count(*) AS rows_here, sum(place - floor(place)) AS to_right FROM (
    SELECT s.grp, s.variable, (val - low) / (high - low) * 511 AS place
    FROM {source} s JOIN widths w ON s.grp IS NOT DISTINCT FROM w.grp AND s.variable = w.variable WHERE val IS NOT NULL)
  GROUP BY 1, 2, 3
), grid AS (
  SELECT *, low - {cut} * bw + step * (high - low + 2 * {cut} * bw) / 511 AS x, (high - low) / 511 AS gap
  FROM widths, range(512) r(step)
)
SELECT g.grp AS "group", g.variable, CAST(step AS INTEGER) AS step, round(any_value(x), 6) AS x,
  round(sum((rows_here - to_right) * exp(-0.5 * pow((x - low - node * gap) / bw, 2))
    + to_right * exp(-0.5 * pow((x - low - (node + 1) * gap) / bw, 2))) / any_value(n * bw * sqrt(2 * pi())), 6) AS density
FROM grid g JOIN nodes k ON g.grp IS NOT DISTINCT FROM k.grp AND g.variable = k.variable GROUP BY 1, 2, 3
"""


@query("t11_violins", _density_sql("compared_scaled", 0.0, False))
def violins(t):
    return _rounded(_comparison(t).densities())


@query("t11_ridges", _density_sql("equity_needs", 3.0, True))
def ridges(t):
    return _rounded(significance.ridges(t.assessments, "basic_needs"))


@query(
    "t11_ridge_medians",
    """SELECT grp AS "group", variable, round(quantile_cont(val, 0.5), 6) AS median FROM equity_needs WHERE val IS NOT NULL GROUP BY 1, 2""",
)
def ridge_medians(t):
    return _rounded(significance.ridge_medians(t.assessments, "basic_needs"))


@query(
    "t9_significance_boxes",
    f"""SELECT grp AS "group", variable, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      round(least(q1, min(val) FILTER (val BETWEEN low_fence AND high_fence)), 6) AS whisker_low,
      round(greatest(q3, max(val) FILTER (val BETWEEN low_fence AND high_fence)), 6) AS whisker_high,
      count(*) FILTER (val NOT BETWEEN low_fence AND high_fence) AS outliers FROM {_FENCED.replace('compared_long', 'equity_long').replace('c.grp = q.grp', 'c.grp IS NOT DISTINCT FROM q.grp')}
      GROUP BY grp, variable, q1, median, q3""",
)
def significance_boxes(t):
    return _rounded(significance.boxes(t.assessments))
