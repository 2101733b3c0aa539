"""Two-group comparison of numeric factors: means, Welch and Tukey tests, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recode
from ..functions.missing import as_column
from ..functions.rules import first_match, rank_of
from ..functions.student import t_p_value, t_quantile
from .keyed import distinct_union
from .reshape import key_first, to_wide

P_ROW = "P Value"
# Upper limits, inclusive.
STARS = ((1e-4, "****"), (1e-3, "***"), (0.01, "**"), (0.05, "*"))
BANDS = ((0.05, "green"), (0.2, "yellow"))


def comparison_table(df: DataFrame, split: str, targets: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """Group label against all others, with the chosen factors in alphabetical order."""
    group = recode.target_or_other(split, targets).alias("group")
    return key_first(df.select(group, *map(as_column, factors)), "group")


def equity_groups(df: DataFrame, race: str = "race", ethnicity: str = "ethnicity") -> DataFrame:
    """Rows with a usable race, labelled White or BIPOC."""
    usable = df.filter(recode.has_usable_race(race, ethnicity))
    return usable.withColumn("group", recode.white_or_bipoc(race, ethnicity))


def moments(df: DataFrame, group: str, factors: Sequence[str]) -> DataFrame:
    """Count, mean and variance per (group, factor), missing values skipped.

    One aggregate over the wide table: rows are never multiplied by the factors.
    """
    aggregates = []
    for i, f in enumerate(factors):
        value = as_column(f).cast("double")
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.var_samp(value).alias(f"var{i}"),
        ]
    entries = [
        F.struct(
            F.lit(f).alias("variable"),
            F.col(f"n{i}").alias("n"),
            F.col(f"mean{i}").alias("mean"),
            F.col(f"var{i}").alias("var"),
        )
        for i, f in enumerate(factors)
    ]
    return df.groupBy(group).agg(*aggregates).select(group, F.inline(F.array(*entries)))


def _side_by_side(per_group: DataFrame, group: str, groups: Sequence[str]) -> DataFrame:
    """One row per variable with n1, mean1, var1, n2, mean2, var2."""
    sides = []
    for i, label in enumerate(groups, start=1):
        here = F.col(group) == label
        sides += [F.max(F.when(here, F.col(c))).alias(f"{c}{i}") for c in ("n", "mean", "var")]
    return per_group.groupBy("variable").agg(*sides).filter((F.col("n1") > 0) & (F.col("n2") > 0))


def welch_tests(
    df: DataFrame,
    group: str,
    factors: Sequence[str],
    groups: Sequence[str],
    *,
    p_digits: int | None = None,
) -> DataFrame:
    """Two-sample t-test with unequal variances, one row per factor, p not adjusted.

    ``groups`` are the two labels in order; the estimate is the first mean minus the second.
    With ``p_digits`` p is rounded to so many significant digits, and the stars follow from that.
    """
    first, second = groups
    sides = _side_by_side(moments(df, group, factors), group, groups)
    e1, e2 = F.try_divide("var1", "n1"), F.try_divide("var2", "n2")
    error = F.sqrt(e1 + e2)
    freedom = F.try_divide(
        (e1 + e2) * (e1 + e2),
        F.try_divide(e1 * e1, F.col("n1") - 1) + F.try_divide(e2 * e2, F.col("n2") - 1),
    )
    tests = sides.select(
        "variable",
        (F.col("mean1") - F.col("mean2")).alias("estimate"),
        F.col("mean1").alias("estimate1"),
        F.col("mean2").alias("estimate2"),
        F.lit(first).alias("group1"),
        F.lit(second).alias("group2"),
        "n1",
        "n2",
        F.try_divide(F.col("mean1") - F.col("mean2"), error).alias("statistic"),
        freedom.alias("df"),
        error.alias("error"),
    ).withColumn("p", _known(t_p_value("statistic", "df")))
    reach = F.col("error") * _known(t_quantile(F.lit(0.975), "df"))
    tests = tests.withColumns(
        {"conf_low": F.col("estimate") - reach, "conf_high": F.col("estimate") + reach}
    )
    if p_digits is not None:
        tests = tests.withColumn("p", significant(F.col("p"), p_digits))
    return tests.drop("error").withColumns({"p_adjusted": F.col("p"), "p_signif": stars("p")})


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def significant(number: Column, digits: int) -> Column:
    """Rounded to significant digits; zero and missing stay."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(number))))
    return F.coalesce(F.round(number * scale) / scale, number)


def stars(p: str) -> Column:
    rules = [(F.col(p) <= limit, label) for limit, label in STARS]
    return first_match([*rules, (F.col(p).isNotNull(), "ns")])


def band(p: str) -> Column:
    rules = [(F.col(p) <= limit, label) for limit, label in BANDS]
    return first_match(rules, otherwise="white")


def tukey_tests(df: DataFrame, group: str, factors: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Honest significant difference of two groups, one row per factor.

    With two groups the studentized range is the square root of two times the pooled
    t statistic, so the adjusted p-value is the pooled two-sided one.
    """
    return _tukey(moments(df, group, factors), group, groups)


def _tukey(per_group: DataFrame, group: str, groups: Sequence[str]) -> DataFrame:
    sides = _side_by_side(per_group, group, groups)
    freedom = F.col("n1") + F.col("n2") - 2
    spread = (F.col("n1") - 1) * F.coalesce("var1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce(
        "var2", F.lit(0.0)
    )
    pooled = F.try_divide(spread, freedom)
    error = F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    return sides.select(
        "variable",
        (F.col("mean2") - F.col("mean1")).alias("difference"),
        F.try_divide(F.col("mean2") - F.col("mean1"), error).alias("statistic"),
        freedom.cast("double").alias("df"),
    ).withColumn("p_value", _known(t_p_value("statistic", "df")))


def averages_table(df: DataFrame, group: str, factors: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Mean of every factor for the target group and the others, then the p-values.

    Columns are the group and the factors in the order given; rows are in report order.
    """
    per_group = moments(df, group, factors)
    means = to_wide(per_group.select(group, "variable", F.col("mean").alias("value")), group, factors)
    tests = _tukey(per_group, group, groups).select(
        F.lit(P_ROW).alias(group), "variable", F.col("p_value").alias("value")
    )
    table = distinct_union(means, to_wide(tests, group, factors))
    return table.orderBy(rank_of(group, [*groups, P_ROW])).select(*map(as_column, [group, *factors]))


def significance_bands(tests: DataFrame) -> DataFrame:
    """Band of each factor's p-value, as shaded in the averages table."""
    return tests.select("variable", "p_value", band("p_value").alias("band"))
