"""Distribution summaries per (group, variable) of a long table.

``long`` has the columns group, variable and value (see ``reshape.to_long``). The
groups of a comparison are named by the caller, so every table per group and variable
has a size fixed by the query, not by the data, and may be broadcast. A missing group is a
group of its own where the caller names it, as None.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import as_column
from .keyed import alike, join_on
from .reshape import scaled_long

KEY = ["group", "variable"]
QUARTILES = (0.25, 0.5, 0.75)
# Cells per doubling of a value, and even slices of a cell.
PER_DOUBLING = 256
SLICES = 4096
# Beyond the exponents of all doubles, from -1074 to 1024.
EXPONENTS = 1100


def distribution_rows(df: DataFrame, factors: Sequence[str], *, strict: bool = False) -> DataFrame:
    """Scaled factors in long form without missing values, with the factor's position."""
    long = scaled_long(df, "group", factors, strict=strict)
    place = F.array_position(F.array(*map(F.lit, factors)), F.col("variable"))
    return long.withColumn("place", place.cast("int"))


def _of_groups(long: DataFrame, groups: Sequence[str | None]) -> DataFrame:
    """Known values of the named groups; None names the missing group."""
    group = F.col("group")
    named = group.isin([g for g in groups if g is not None])
    if None in groups:
        named = named | group.isNull()
    return long.filter(named & F.col("value").isNotNull()).select(*KEY, "value")


def _cell(value: Column) -> Column:
    """Number of a narrow range of values, in the order of the values: sign, then logarithm of the size."""
    size = F.least(F.log2(F.abs(value)), F.lit(float(EXPONENTS)))
    place = F.floor(size * PER_DOUBLING) + EXPONENTS * PER_DOUBLING
    return F.when(value > 0, place).when(value < 0, -place).otherwise(F.lit(0).cast("long"))


def summary(
    long: DataFrame,
    groups: Sequence[str | None],
    probs: Sequence[float] = QUARTILES,
) -> DataFrame:
    """Size, range, deviation and exact quantiles (linear interpolation) in one row.

    Columns: group, variable, n, low, high, sd and ``quantiles``, one per prob.

    One pass counts the rows of each cell, a range of values whose number any task can tell from the value alone. The
    cells' running totals say which ones hold a wanted rank. A second pass cuts those into even slices, and only the
    distinct values of the slices that hold a rank are put in order. Counts are combined within tasks, a key has at most
    ``2 * EXPONENTS * PER_DOUBLING`` cells whatever its rows, and repeated values are one row.
    """
    rows = _of_groups(long, groups)
    value, n, count = F.col("value"), F.col("n"), F.col("rows")
    ranks = [(n - 1) * F.lit(float(p)) for p in probs]
    wanted = [f(rank) for rank in ranks for f in (F.floor, F.ceil)]

    def holds_a_rank(before: Column) -> Column:
        return reduce(Column.__or__, [(before <= at) & (before + count > at) for at in wanted])

    cells = rows.groupBy(*KEY, _cell(value).alias("cell")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("value").alias("cell_low"),
        F.max("value").alias("cell_high"),
        F.avg("value").alias("cell_mean"),
        F.var_pop("value").alias("cell_var"),
    )
    whole = Window.partitionBy(*KEY)
    totals = cells.withColumns(
        {
            "n": F.sum("rows").over(whole),
            "low": F.min("cell_low").over(whole),
            "high": F.max("cell_high").over(whole),
            "mean": F.sum(count * F.col("cell_mean")).over(whole) / F.sum("rows").over(whole),
            "before": F.sum("rows").over(whole.orderBy("cell")) - count,
        }
    )
    apart = F.col("cell_mean") - F.col("mean")
    squares = F.sum(count * (F.col("cell_var") + apart * apart)).over(whole)
    fixed = [*KEY, "n", "low", "high", "sd"]
    needed = (
        totals.withColumn("sd", F.when(n > 1, F.sqrt(squares / (n - 1))))
        .filter(holds_a_rank(F.col("before")))
        .select(*fixed, "cell", "cell_low", "cell_high", "before")
    )
    share = F.try_divide(value - F.col("cell_low"), F.col("cell_high") - F.col("cell_low"))
    known_share = F.when(~F.isnan(share), share)
    # Null-safe joins: Spark infers no filter through them, so both uses of the tally stay
    # alike and share one shuffle.
    tally = (
        join_on(rows.withColumn("cell", _cell(value)), F.broadcast(needed), [*KEY, "cell"], "inner")
        .groupBy(*fixed, "cell", "before", F.coalesce(F.floor(known_share * SLICES), F.lit(0)).alias("slice"), "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    within_cell = Window.partitionBy(*KEY, "cell").orderBy("slice")
    slices = (
        tally.groupBy(*KEY, "n", "cell", "before", "slice")
        .agg(F.sum("rows").alias("rows"))
        .withColumn("first", F.col("before") + F.sum("rows").over(within_cell) - count)
        .filter(holds_a_rank(F.col("first")))
        .select(*KEY, "cell", "slice", "first")
    )
    within_slice = Window.partitionBy(*KEY, "cell", "slice").orderBy("value")
    ordered = join_on(tally, F.broadcast(slices), [*KEY, "cell", "slice"], "inner").withColumn(
        "place", F.col("first") + F.sum("rows").over(within_slice) - count
    )
    place = F.col("place")
    at_rank = [
        F.max(F.when((place <= at) & (place + count > at), value)).alias(f"at{i}")
        for i, at in enumerate(wanted)
    ]
    found = ordered.groupBy(*fixed).agg(*at_rank)
    results = []
    for i, rank in enumerate(ranks):
        lower, upper = F.col(f"at{2 * i}"), F.col(f"at{2 * i + 1}")
        results.append(lower + (rank - F.floor(rank)) * (upper - lower))
    return found.select(*fixed, F.array(*results).alias("quantiles"))


def quantiles(
    long: DataFrame,
    groups: Sequence[str | None],
    probs: Sequence[float] = QUARTILES,
) -> DataFrame:
    """Exact quantiles: rows (group, variable, prob, value)."""
    rows = [
        F.struct(F.lit(float(p)).alias("prob"), F.col("quantiles")[i].alias("value"))
        for i, p in enumerate(probs)
    ]
    return summary(long, groups, probs).select(*KEY, F.inline(F.array(*rows)))


def _named_quartiles(q: str) -> list[Column]:
    return [F.col(q)[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))]


def quartile_table(long: DataFrame, groups: Sequence[str | None], *, approximate: bool = False) -> DataFrame:
    """Median, quartiles and range per (group, variable): q1, median, q3, low, high."""
    if approximate:
        sketch = F.percentile_approx("value", list(QUARTILES), 10_000)
        ends = [F.min("value").alias("low"), F.max("value").alias("high")]
        rows = _of_groups(long, groups).groupBy(*KEY).agg(sketch.alias("quantiles"), *ends)
    else:
        rows = summary(long, groups)
    return rows.select(*KEY, *_named_quartiles("quantiles"), "low", "high")


def _fenced(long: DataFrame, groups: Sequence[str | None]) -> DataFrame:
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    quartiles = quartile_table(long, groups).drop("low", "high").withColumns(
        {"low_fence": F.col("q1") - reach, "high_fence": F.col("q3") + reach}
    )
    return join_on(_of_groups(long, groups), F.broadcast(quartiles), KEY, "inner")


def box_table(long: DataFrame, groups: Sequence[str | None]) -> DataFrame:
    """Quartiles, whiskers, outlier count. Whiskers reach to the last value within 1.5 interquartile ranges, or to the
    quartile where that lies beyond it."""
    value = F.col("value")
    inside = value.between(F.col("low_fence"), F.col("high_fence"))
    return (
        _fenced(long, groups)
        .groupBy(*KEY, "q1", "median", "q3")
        .agg(
            F.least("q1", F.min(F.when(inside, value))).alias("whisker_low"),
            F.greatest("q3", F.max(F.when(inside, value))).alias("whisker_high"),
            F.count(F.when(~inside, 1)).alias("outliers"),
        )
    )


def outlier_values(long: DataFrame, groups: Sequence[str | None]) -> DataFrame:
    """Values beyond the whiskers, each with its number of rows."""
    outside = ~F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    return _fenced(long, groups).filter(outside).groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, group: str, factor: str) -> DataFrame:
    """Rows per unit bin, bins centred on whole numbers and closed on the right."""
    bin_centre = F.ceil(as_column(factor) - 0.5).cast("long")
    return (
        df.filter(as_column(factor).isNotNull())
        .groupBy(group, bin_centre.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bandwidths(long: DataFrame, groups: Sequence[str | None]) -> DataFrame:
    """Range, size and rule-of-thumb kernel bandwidth per (group, variable)."""
    rows = summary(long, groups, (0.25, 0.75))
    iqr = (F.col("quantiles")[1] - F.col("quantiles")[0]) / 1.34
    # A zero spread falls back to the deviation, the value itself, then one.
    spread = F.coalesce(
        *[F.when(c != 0, c) for c in (F.least(F.col("sd"), iqr), F.col("sd"), F.abs("low"))],
        F.lit(1.0),
    )
    width = 0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return rows.select(*KEY, "n", "low", "high", width.alias("bandwidth"))


def _shared(widths: DataFrame) -> DataFrame:
    """One range and the mean bandwidth for all groups of a variable."""
    variable = Window.partitionBy("variable")
    return widths.select(
        *KEY,
        "n",
        F.min("low").over(variable).alias("low"),
        F.max("high").over(variable).alias("high"),
        F.avg("bandwidth").over(variable).alias("bandwidth"),
    )


def density(
    long: DataFrame,
    groups: Sequence[str | None],
    *,
    points: int = 512,
    cut: float = 0.0,
    shared: bool = False,
    with_range: bool = False,
) -> DataFrame:
    """Gaussian kernel density on an even grid: rows (group, variable, step, x, density).

    The grid covers the range of the values (``cut=0``, as trimmed violins do) or
    reaches ``cut`` bandwidths beyond (3 for ridges); ``shared`` uses one range and the
    mean bandwidth for all groups of a variable; ``with_range`` adds the range, low and high. Values are first split between
    the two nearest of ``points`` nodes, so the kernel sum costs the same for any
    number of rows and each list of nodes has at most ``points`` entries.
    """
    widths = alike(bandwidths(long, groups))
    if shared:
        widths = _shared(widths)
    place = F.coalesce(
        F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")) * (points - 1),
        F.lit(0.0),
    )
    nodes = (
        join_on(_of_groups(long, groups), F.broadcast(widths), KEY, "inner")
        .select(*KEY, place.alias("place"))
        .groupBy(*KEY, F.floor("place").alias("node"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col("place") - F.floor("place")).alias("right"),
        )
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("node", "rows", "right")).alias("nodes"))
    )
    gap = (F.col("high") - F.col("low")) / (points - 1)
    start = F.col("low") - cut * F.col("bandwidth")
    stride = (F.col("high") - F.col("low") + 2 * cut * F.col("bandwidth")) / (points - 1)
    grid = join_on(nodes, F.broadcast(widths), KEY, "inner").select(
        *KEY, "n", "low", "high", "bandwidth", "nodes", gap.alias("gap"), start.alias("start"), stride.alias("stride"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"),
    ).withColumn("x", F.col("start") + F.col("step") * F.col("stride"))

    def kernel(node: Column) -> Column:
        z = (F.col("x") - F.col("low") - node * F.col("gap")) / F.col("bandwidth")
        return F.exp(-0.5 * z * z)

    total = F.aggregate(
        "nodes",
        F.lit(0.0),
        lambda acc, c: acc
        + (c["rows"] - c["right"]) * kernel(c["node"])
        + c["right"] * kernel(c["node"] + 1),
    )
    scale = F.col("n") * F.col("bandwidth") * F.sqrt(2 * F.pi())
    range_of_key = ["low", "high"] if with_range else []
    return grid.select(*KEY, "step", "x", (total / scale).alias("density"), *range_of_key)
