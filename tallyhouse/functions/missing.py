"""Missing-value policies.

The case reports treat a missing value as a value of its own when they group,
join or count, and as "unknown" when they test a condition. Spark's defaults
differ in several places; every such place goes through a function here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    """Column by its exact name; uploaded tables have dots and spaces in theirs."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def strict_if(condition: Column, yes, no) -> Column:
    """Two-way choice that stays missing while the condition is unknown."""
    return F.when(condition, yes).when(~condition, no)


def within(c: ColumnLike, values: Iterable) -> Column:
    """Membership test that is false, never missing, for a missing value."""
    return F.coalesce(as_column(c).isin(list(values)), F.lit(False))


def holds(condition: Column) -> Column:
    """A predicate with unknown read as false, safe to negate or to store."""
    return F.coalesce(condition, F.lit(False))


def largest(c: ColumnLike, missing: str = "skip") -> Column:
    """Aggregate maximum under a missing-value policy.

    ``skip`` ignores missing values, ``propagate`` is missing as soon as one
    value is, ``infinite`` is -infinity (as double) when nothing is known.
    """
    return _extremum(F.max, as_column(c), missing, float("-inf"))


def smallest(c: ColumnLike, missing: str = "skip") -> Column:
    """Aggregate minimum; see :func:`largest` (``infinite`` gives +infinity)."""
    return _extremum(F.min, as_column(c), missing, float("inf"))


def _extremum(aggregate, c: Column, missing: str, empty: float) -> Column:
    if missing == "skip":
        return aggregate(c)
    if missing == "propagate":
        return F.when(F.count(c) == F.count(F.lit(1)), aggregate(c))
    if missing == "infinite":
        return F.coalesce(aggregate(c).cast("double"), F.lit(empty))
    raise ValueError(f"unknown missing-value policy {missing!r}")


def any_flag(condition: Column, missing: str = "propagate") -> Column:
    """Aggregate: 1 if the condition holds on any row of the group."""
    return largest(strict_if(condition, 1, 0), missing)


def all_flag(condition: Column, missing: str = "propagate") -> Column:
    """Aggregate: 1 if the condition holds on every row of the group."""
    return smallest(strict_if(condition, 1, 0), missing)


def up(c: ColumnLike) -> Column:
    """Ascending sort key, missing values last."""
    return as_column(c).asc_nulls_last()


def down(c: ColumnLike) -> Column:
    """Descending sort key, missing values last."""
    return as_column(c).desc_nulls_last()
