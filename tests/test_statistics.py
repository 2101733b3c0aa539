import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import student
from tallyhouse.operators import compare, distributions, reshape


def simpson_p(t, df, n=20000):
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    x = np.linspace(0, abs(t), n + 1)
    y = scale * (1 + x * x / df) ** (-(df + 1) / 2)
    w = np.ones(n + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return 1 - 2 * float((w * y).sum()) * abs(t) / n / 3


@pytest.mark.parametrize("t,df", [(2, 10), (0.3, 3.5), (1.96, 1000), (4, 55.2), (0, 7), (2.5, 1)])
def test_t_tail(t, df):
    assert student.two_sided_p(t, df) == pytest.approx(simpson_p(t, df), abs=1e-10)


def test_t_tail_known_value_and_limits():
    assert student.two_sided_p(2, 10) == pytest.approx(0.0733880348, abs=1e-10)
    assert student.two_sided_p(-2, 10) == student.two_sided_p(2, 10)
    assert student.two_sided_p(float("inf"), 5) == 0
    assert math.isnan(student.two_sided_p(1.0, float("nan")))


@pytest.mark.parametrize("df", [1e5, 1e6, 1e7, 1e9, 1e12])
@pytest.mark.parametrize("t", [0.0, 0.5, 1.96, 4.0, 12.0, 30.0])
def test_t_tail_by_the_normal_tail_and_its_series(t, df):
    """Expansion of the tail in 1/df, to the second order, about the normal tail."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    first = t * (t**2 + 1) / 4
    second = t * (3 * t**6 - 7 * t**4 - 5 * t**2 - 3) / 96
    expected = math.erfc(t / math.sqrt(2)) + 2 * density * (first / df + second / df**2)
    assert student.two_sided_p(t, df) == pytest.approx(expected, rel=1e-11 + (t**4 / df) ** 3)


def test_t_tail_of_few_degrees_of_freedom():
    for t in (0.0, 0.01, 1.0, 50.0, 1e6):
        assert student.two_sided_p(t, 1) == pytest.approx(2 / math.pi * math.atan2(1, t), rel=1e-10)
        assert student.two_sided_p(t, 2) == pytest.approx(2 / (2 + t * t + t * math.sqrt(2 + t * t)), rel=1e-10)


@pytest.mark.parametrize("df", [1.5, 8, 120, 5e6])
def test_t_quantile_inverts_the_tail(df):
    assert student.two_sided_p(student.quantile(0.975, df), df) == pytest.approx(0.05, abs=1e-9)


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    rows = [
        ("BIPOC" if rng.random() < 0.4 else "White", rng.gauss(3, 2), float(rng.randint(0, 6)), None if rng.random() < 0.2 else rng.expovariate(1), 1.0)
        for _ in range(3000)
    ]
    return spark.createDataFrame(rows, "group string, a double, b double, c double, flat double"), rows


FACTORS = ["a", "b", "c", "flat"]
GROUPS = ("BIPOC", "White")


def column(rows, group, i):
    return np.array([r[i] for r in rows if r[0] == group and r[i] is not None])


def test_welch(sample):
    df, rows = sample
    tests = {r.variable: r for r in compare.welch_tests(df, "group", FACTORS, GROUPS).collect()}
    for i, f in enumerate("abc", start=1):
        x, y = column(rows, "BIPOC", i), column(rows, "White", i)
        vx, vy = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
        t = (x.mean() - y.mean()) / math.sqrt(vx + vy)
        freedom = (vx + vy) ** 2 / (vx**2 / (len(x) - 1) + vy**2 / (len(y) - 1))
        got = tests[f]
        assert (got.n1, got.n2) == (len(x), len(y))
        assert got.statistic == pytest.approx(t) and got.df == pytest.approx(freedom)
        assert got.p == pytest.approx(simpson_p(t, freedom), abs=1e-9)
        assert got.conf_low < got.estimate < got.conf_high
        reach = (got.conf_high - got.estimate) / math.sqrt(vx + vy)
        assert student.two_sided_p(reach, freedom) == pytest.approx(0.05, abs=1e-9)
        assert got.p_signif == ("ns" if got.p > 0.05 else got.p_signif)
    assert tests["flat"].statistic is None and tests["flat"].p is None


def test_scaling_leaves_the_test_unchanged(sample):
    df, _ = sample
    raw = {r.variable: r for r in compare.welch_tests(df, "group", FACTORS, GROUPS).collect()}
    scaled = reshape.scaled(df, FACTORS, strict=True)
    got = {r.variable: r for r in compare.welch_tests(scaled, "group", FACTORS, GROUPS).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].p == pytest.approx(raw["a"].p) and got["a"].statistic == pytest.approx(raw["a"].statistic)


def test_tukey_is_the_pooled_test(sample):
    df, rows = sample
    tests = {r.variable: r for r in compare.tukey_tests(df, "group", FACTORS, GROUPS).collect()}
    for i, f in enumerate("abc", start=1):
        x, y = column(rows, "BIPOC", i), column(rows, "White", i)
        n = len(x) + len(y) - 2
        pooled = ((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / n
        t = (y.mean() - x.mean()) / math.sqrt(pooled * (1 / len(x) + 1 / len(y)))
        assert tests[f].p_value == pytest.approx(simpson_p(t, n), abs=1e-9)


def test_p_in_significant_digits(sample, frame):
    df, _ = sample
    whole = {r.variable: r.p for r in compare.welch_tests(df, "group", FACTORS, GROUPS).collect()}
    for r in compare.welch_tests(df, "group", FACTORS, GROUPS, p_digits=3).collect():
        assert r.p == (None if whole[r.variable] is None else pytest.approx(float(f"{whole[r.variable]:.2e}"), rel=1e-12))
    numbers = frame("x double", (0.0,), (None,), (0.00123456,), (1.0,), (3.21987e-30,))
    got = [r[0] for r in numbers.select(compare.significant(F.col("x"), 3)).collect()]
    assert got[:2] == [0.0, None] and got[2:] == pytest.approx([0.00123, 1.0, 3.22e-30], rel=1e-12)


def test_averages_table_order(sample):
    df, _ = sample
    rows = compare.averages_table(df, "group", ["b", "a"], GROUPS).collect()
    assert [r.group for r in rows] == ["BIPOC", "White", "P Value"] and rows[0].__fields__ == ["group", "b", "a"]


def test_bands_and_stars_include_their_limits(frame):
    df = frame("p double", (0.05,), (0.2,), (0.21,), (1e-4,), (0.01,), (None,))
    got = [tuple(r) for r in df.select(compare.band("p"), compare.stars("p")).collect()]
    assert got == [("green", "*"), ("yellow", "ns"), ("white", "ns"), ("green", "****"), ("green", "**"), ("white", None)]


def test_exact_quantiles(sample):
    df, rows = sample
    long = reshape.to_long(df, "group", FACTORS)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {(r.group, r.variable, r.prob): r.value for r in distributions.quantiles(long, GROUPS, probs).collect()}
    assert len(got) == 2 * 4 * len(probs)
    for (group, variable, p), value in got.items():
        x = column(rows, group, FACTORS.index(variable) + 1)
        assert value == pytest.approx(np.quantile(x, p), abs=1e-12)


def test_exact_quantiles_with_one_hot_value_and_outliers(spark):
    """A third of the rows share a value; the rest reaches over many magnitudes."""
    rng = random.Random(7)
    values = [4.0] * 4000 + [math.exp(rng.uniform(-30, 30)) for _ in range(8000)]
    rng.shuffle(values)
    long = spark.createDataFrame([("x", "v", v) for v in values], "group string, variable string, value double")
    got = {r.prob: r.value for r in distributions.quantiles(long, ["x"]).collect()}
    for p, value in got.items():
        assert value == pytest.approx(np.quantile(values, p), rel=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_exact_quantiles_of_both_signs_and_all_sizes(spark, seed):
    """Values of both signs, zeros, the smallest and largest doubles, and some that differ in their last bits only."""
    rng = random.Random(seed)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, -1.0, 2.0, 4.0]
    values += [rng.choice((-1, 1)) * math.exp(rng.uniform(-40, 40)) for _ in range(300)]
    values += [1.6e9 + rng.randint(0, 9) * 2.0**-22 for _ in range(700 * (seed % 2))]
    long = spark.createDataFrame([("x", "v", v) for v in values], "group string, variable string, value double")
    probs = (0.0, 0.01, 0.25, 0.3, 0.5, 0.75, 0.9, 1.0)
    row = distributions.summary(long, ["x"], probs).first()
    assert (row.n, row.low, row.high) == (len(values), min(values), max(values))
    assert row.quantiles == pytest.approx([np.quantile(values, p) for p in probs], rel=1e-12)


def test_summary_of_infinite_values_and_deviation(frame):
    inf = float("inf")
    long = frame("group string, variable string, value double", *(("x", "v", v) for v in (-inf, -1.0, 2.0, inf, inf)), ("y", "v", 3.0), ("y", "v", 5.5), (None, "v", 1.0))
    got = {r.group: r for r in distributions.summary(long, ["x", "y", None], (0.25, 0.5)).collect()}
    assert got["x"].quantiles == [-1.0, 2.0] and got["y"].quantiles == [3.625, 4.25] and got[None].quantiles == [1.0, 1.0]
    assert got["y"].sd == pytest.approx(np.std([3.0, 5.5], ddof=1)) and got[None].sd is None


def test_quantiles_take_two_passes_without_sketches(sample):
    df, _ = sample
    rows = reshape.to_long(df, "group", FACTORS)
    plan = distributions.summary(rows, GROUPS)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "raise_error" not in plan


def test_small_groups(frame):
    long = frame("group string, variable string, value double", ("x", "v", 1.0), ("y", "v", 1.0), ("y", "v", 2.0), ("z", "v", None))
    got = {(r.group, r.median) for r in distributions.quartile_table(long, ["x", "y", "z"]).collect()}
    assert got == {("x", 1.0), ("y", 1.5)}


def test_boxes_and_outliers(frame):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 40.0, 40.0, -30.0]
    long = frame("group string, variable string, value double", *[("g", "v", x) for x in data])
    q1, q3 = np.quantile(data, [0.25, 0.75])
    reach = 1.5 * (q3 - q1)
    inside = [x for x in data if q1 - reach <= x <= q3 + reach]
    box = distributions.box_table(long, ["g"]).first()
    assert (box.whisker_low, box.whisker_high, box.outliers) == (min(inside), max(inside), len(data) - len(inside))
    assert {tuple(r)[2:] for r in distributions.outlier_values(long, ["g"]).collect()} == {(40.0, 2), (-30.0, 1)}


def test_histogram_bins_close_on_the_right(frame):
    df = frame("g string, x double", *[("a", v) for v in (0.5, 0.51, 1.0, 1.5, 1.51, None)])
    assert {(r.bin, r.n) for r in distributions.histogram(df, "g", "x").collect()} == {(0, 1), (1, 3), (2, 1)}


def test_density_against_direct_sum(sample):
    df, rows = sample
    long = reshape.to_long(df, "group", ["a"])
    got = [r for r in distributions.density(long, GROUPS, cut=3.0).collect() if r.group == "White"]
    x = column(rows, "White", 1)
    q1, q3 = np.quantile(x, [0.25, 0.75])
    width = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    assert len(got) == 512
    for r in got[::37]:
        direct = np.exp(-0.5 * ((r.x - x) / width) ** 2).sum() / (len(x) * width * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(direct, abs=2e-5)
    xs = np.array(sorted((r.x, r.density) for r in got))
    assert np.trapezoid(xs[:, 1], xs[:, 0]) == pytest.approx(1, abs=1e-3)


def test_density_of_a_constant(frame):
    long = frame("group string, variable string, value double", *[("g", "v", 2.0)] * 5)
    rows = distributions.density(long, ["g"], points=8).collect()
    assert len(rows) == 8 and all(r.x == 2.0 and r.density > 0 for r in rows)


def test_long_and_wide_round_trip(sample):
    df, _ = sample
    long = reshape.to_long(df, "group", ["a", "b"])
    assert long.count() == 2 * df.count()
    means = long.groupBy("group", "variable").agg(F.avg("value").alias("value"))
    wide = reshape.to_wide(means, "group", ["b", "a"])
    assert wide.columns == ["group", "b", "a"] and wide.count() == 2


def test_names_with_dots_and_spaces(spark):
    rows = [("White (HUD)" if i % 3 else "Other", "x", float(i % 7), float(i % 5), None) for i in range(60)]
    raw = spark.createDataFrame(rows, "`Race.Code` string, `My.Ethnicity` string, `Basic.Needs` double, `Total score` double, `No.Data` double")
    from tallyhouse.plans import equity, significance

    chosen = equity.comparison(raw, ["White (HUD)"])
    assert chosen.factors == ("Basic.Needs", "Total score")
    assert chosen.averages().columns == ["group", "Basic.Needs", "Total score"]
    assert chosen.averages().count() == 3
    assert {r.variable for r in chosen.bands().collect()} == set(chosen.factors)
    assert chosen.medians().count() == 4 and chosen.densities(8).count() == 32
    assert equity.choices(raw, "Race.Code").count() == 2
    table = raw.withColumnsRenamed({"Race.Code": "race", "My.Ethnicity": "ethnicity"})
    assert {r.variable for r in significance.tests(table).collect()} == set(chosen.factors)
    assert significance.boxes(table, normalised=True).count() == 4
    assert significance.histogram(table, "Basic.Needs").count() > 5
    assert significance.ridges(table, "Basic.Needs", 8).count() == 16
    assert significance.ridge_medians(table, "Basic.Needs").count() == 2


def test_whiskers_reach_the_quartiles(frame):
    long = frame("group string, variable string, value double", *(("x", "v", v) for v in (-100.0, 10.0, 11.0, 12.0)))
    row = distributions.box_table(long, ["x"]).first()
    assert (row.q1, row.whisker_low, row.whisker_high, row.outliers) == (-17.5, -17.5, 12.0, 1)
