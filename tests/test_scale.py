"""Plans that must hold when one key has a third of all rows."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tallyhouse.catalog.registry import Tables
from tallyhouse.functions.missing import down, largest, up
from tallyhouse.operators import households, identity
from tallyhouse.operators.keyed import attach, first_per_key, weighted_left_join
from tallyhouse.operators.metrics import Metric, distinct_counts
from tallyhouse.plans import by_name_list, hotline


@contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): str(v) for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def small_shuffle_splits(spark):
    """Cluster behaviour at test size: shuffled joins, split from 100 kB on."""
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__advisoryPartitionSizeInBytes="50kb",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100kb",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor=2,
    ):
        yield


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def hot_rows(spark):
    """A third of the rows under the missing key."""
    key = F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5000)
    return spark.range(120_000, numPartitions=8).select(
        key.alias("k"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("text")
    )


def test_hot_key_of_attached_columns_is_split(hot_rows, small_shuffle_splits):
    out = attach(hot_rows, ["k"], n=F.count(F.lit(1)), top=largest("id"))
    plan = final_plan(out)
    assert "skew=true" in plan and "Window" not in plan
    assert out.filter("k IS NULL AND n = 40000").count() == 40_000
    assert out.count() == 120_000


def test_hot_key_on_the_right_of_a_left_join_is_split(spark, hot_rows, small_shuffle_splits):
    left = spark.range(0, 6000).select(F.when(F.col("id") < 1, None).otherwise(F.col("id")).alias("k"))
    out = weighted_left_join(left, hot_rows, ["k"])
    assert "skew=true" in final_plan(out)
    assert out.filter("k IS NULL").count() == 40_000 and out.filter("id IS NULL").count() == 1000 + sum(
        1 for k in range(1, 5000) if not any((k + 5000 * j) % 3 for j in range(24))
    )


def test_top_row_is_cut_before_the_shuffle(hot_rows):
    plan = final_plan(first_per_key(hot_rows, ["k"], [down("id"), up("text")]))
    before_shuffle = plan.split("Exchange")[1]
    assert "WindowGroupLimit" in before_shuffle


def test_metrics_take_one_shuffle_per_pass(hot_rows):
    metrics = [Metric(f"m{i}", key, F.col("id") % (i + 2) == 0) for i in range(40) for key in ("k", "text")]
    counts = distinct_counts(hot_rows, metrics)
    assert shuffles(counts) == 1 and "Expand" not in planned(counts)
    got = {(r.metric): r.value for r in distinct_counts(hot_rows, metrics[1::2]).collect()}
    assert all(got[f"m{i}"] == 120_000 // (i + 2) + (120_000 % (i + 2) > 0) for i in range(40))


def test_more_metrics_than_one_mask_holds(hot_rows):
    metrics = [Metric(f"m{i}", "k", F.col("id") < i) for i in range(150)]
    got = {r.metric: r.value for r in distinct_counts(hot_rows, metrics).collect()}
    assert got["m0"] == 0 and got["m1"] == 1 and got["m149"] == 1 + sum(1 for i in range(149) if i % 3)


def test_no_window_runs_over_calls_or_members(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    members = by_name_list.list_members(t.clients, "20220101", "20221231")
    rolled = households.household_members(members, by_name_list.cleaned_memberships(t.memberships))
    assert "Window" not in planned(rolled)
    calls = hotline.all_calls(t.calls, t.situations, t.caller_demographics, t.callpoint)
    assert "Window" not in planned(calls)
    # Windows of the identity step sit on the (name, birth date) aggregate.
    for window in re.findall(r"Window \[.*?\n(.*\n.*\n)", planned(identity.resolved_people(calls))):
        assert "Aggregate" in window or "Window" in window or "Project" in window


def test_hotline_is_stable_under_partitioning_and_splitting(spark, small_shuffle_splits):
    t = Tables(spark, "/root/testdata/sf0.001")
    sources = (t.calls, t.situations, t.caller_demographics, t.callpoint)
    want = {tuple(r) for r in hotline.report(*sources).collect()}
    shuffled = [s.repartition(n) for s, n in zip(sources, (5, 3, 7, 2))]
    with settings(spark, spark__sql__shuffle__partitions=13):
        assert {tuple(r) for r in hotline.report(*shuffled).collect()} == want


def test_hot_unknown_callers(spark, small_shuffle_splits):
    """A third of the calls have neither name nor birth date: one group, one client."""
    calls = spark.range(60_000, numPartitions=6).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("H"), F.col("id") % 700)).alias("household_id"),
        (F.col("id") % 20_000 + 1).alias("client_id"),
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("call_date"),
        F.lit("No (HUD)").alias("veteran_status"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("P"), F.col("id") % 9000)).alias("name_string"),
        F.lit(None).cast("date").alias("birth_date"),
        F.lit("Unknown").alias("housed_status"),
        F.lit(0).alias("bipoc"),
        F.lit(1).alias("asked_shelter"),
    )
    out = identity.resolved_calls(calls)
    assert "skew=true" in final_plan(out)
    unknown = out.filter("name_string IS NULL")
    assert unknown.count() == 20_000 and unknown.select("client_id").distinct().count() == 1


def test_rows_with_attached_columns_are_computed_once(spark):
    """Shuffles and scans at run time, beside reused ones."""
    t = Tables(spark, "/root/testdata/sf0.001")

    def work(df) -> tuple[int, int]:
        plan = final_plan(df)
        return len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)), plan.count("FileScan")

    members = by_name_list.list_members(t.clients, "20220101", "20221231")
    rolled = households.household_members(members, by_name_list.cleaned_memberships(t.memberships))
    moved, read = work(households.largest_household(rolled))
    assert moved <= 9 and read <= 3
    moved, read = work(hotline.report(t.calls, t.situations, t.caller_demographics, t.callpoint))
    assert moved <= 15 and read <= 4
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__autoBroadcastJoinThreshold=-1):
        moved, _ = work(hotline.report(t.calls, t.situations, t.caller_demographics, t.callpoint))
        assert moved <= 23


def test_summary_of_calls_is_that_of_resolved_calls(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for variant in ("v2", "v3"):
        calls = hotline.all_calls(t.calls, t.situations, t.caller_demographics, t.callpoint, variant)
        one = identity.summary_base_of_calls(calls, variant)
        two = identity.summary_base(identity.resolved_calls(calls), variant).select(one.columns)
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
