"""Joins and per-key columns that treat a missing key as a key.

Every join here is null-safe, so Spark shuffles both sides for the join itself and
adaptive execution can split a hot key's rows over many tasks. For the same reason
per-key columns are a pre-aggregated ``groupBy`` joined back, not a window: a window
would put all rows of a hot key, such as the missing household, into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import ColumnLike

On = Sequence[str | tuple[str, str]]


def join_on(left: DataFrame, right: DataFrame, on: On, how: str = "left") -> DataFrame:
    """Null-safe equi-join; the right side's key columns are dropped.

    ``on`` lists column names, or (left name, right name) pairs.
    """
    pairs = [(c, c) if isinstance(c, str) else c for c in on]
    renamed = right.withColumnsRenamed({r: f"__{r}" for _, r in pairs})
    match = reduce(
        Column.__and__, [left[l].eqNullSafe(renamed[f"__{r}"]) for l, r in pairs]
    )
    joined = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__{r}" for _, r in pairs])


def attach(rows: DataFrame, keys: Sequence[str], *, shared: bool = False, **measures: Column) -> DataFrame:
    """Add aggregates over each key as columns of every row.

    ``shared`` is for rows that come out of a shuffle or join: both the aggregate and the rows then read all
    their columns, so that Spark sees one plan twice and runs what lies before them once. Leave it off for
    rows of a file, where the aggregate reads few columns.
    """
    if shared:
        rows = alike(rows)
    return join_on(rows, rows.groupBy(*keys).agg(*_named(measures)), keys)


def alike(rows: DataFrame) -> DataFrame:
    """The rows, read with all their columns by every use, so that uses share the shuffles before them."""
    # Always true, which Spark cannot know.
    return rows.filter(F.xxhash64(*rows.columns) % 2 < 2)


def _named(measures: dict[str, Column]) -> list[Column]:
    return [measure.alias(name) for name, measure in measures.items()]


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike]) -> DataFrame:
    """First row of each key under a total order.

    Spark keeps one row per key and task before the shuffle, so a hot key costs
    one row per task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def first_and_measures(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], **measures: Column
) -> DataFrame:
    """First row of each key, and aggregates over all its rows, in one aggregation.

    ``order`` lists ascending columns, missing values last; rows equal under it must be equal in all columns.
    """
    rest = [c for c in rows.columns if c not in keys]
    places = [part for c in order for part in (c.isNull(), c)]
    least = F.min_by(F.struct(*rest), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(places)]))
    found = rows.groupBy(*keys).agg(least.alias("__first"), *_named(measures))
    return found.select(*keys, *[F.col("__first")[c].alias(c) for c in rest if c not in measures], *measures)


def with_copies(rows: DataFrame, name: str) -> DataFrame:
    """Identical rows folded into one, with their number."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(name))


def weighted_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that may match many to many; ``copies`` counts repeated left rows.

    Identical left rows are folded first, so a key repeated on both sides does not
    multiply into all pairs. The matched and unmatched parts are separate joins because
    an outer join can only be split on its left side, and the hot side may be the right.
    """
    left = with_copies(left, "copies")
    matched = join_on(left, right, on, "inner")
    alone = join_on(left, right.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def merge_unmatched(left: DataFrame, right: DataFrame, on: On, *, distinct: bool = False) -> DataFrame:
    """Full outer join against a table of key columns only, duplicates removed.

    ``distinct`` says that the left rows are distinct already.

    Equals the full join as a set: all left rows, and the right rows with no match.
    One ``groupBy`` over both sides' keys finds the latter; it pre-aggregates, and
    takes a missing key for a value, which an equi-join would need extra work for.
    """
    pairs = [(c, c) if isinstance(c, str) else c for c in on]
    names = [l for l, _ in pairs]
    here = left.select(*names, F.lit(True).alias("__left"))
    there = right.select(*[F.col(r).alias(l) for l, r in pairs], F.lit(False).alias("__left"))
    known = here.unionByName(there).groupBy(*names).agg(F.bool_or("__left").alias("__left"))
    extra = known.filter(~F.col("__left")).drop("__left")
    rows = left if distinct else left.distinct()
    return rows.unionByName(extra, allowMissingColumns=True)


def distinct_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Set union of two result tables."""
    return first.unionByName(second).distinct()
