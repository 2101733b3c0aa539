"""Ordered rules in data, turned into one expression."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_column


def first_match(rules: Iterable[tuple[Column, object]], otherwise=None) -> Column:
    """Value of the first rule whose condition is true; unknown counts as false."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def contains_all(c: ColumnLike, *parts: str) -> Column:
    """Case-sensitive test that every part occurs in the text."""
    found = as_column(c).contains(parts[0])
    for part in parts[1:]:
        found = found & as_column(c).contains(part)
    return found


def rank_of(c: ColumnLike, levels: Sequence[str]) -> Column:
    """Position of a label in an ordered level list; missing outside the list."""
    return first_match([(as_column(c) == level, F.lit(i)) for i, level in enumerate(levels)])


def only_levels(c: ColumnLike, levels: Sequence[str]) -> Column:
    """The label itself, or missing when it is not one of the levels."""
    return F.when(as_column(c).isin(list(levels)), as_column(c))


def client_household(client: ColumnLike) -> Column:
    """Household id of a client that has none: the client id followed by ``-C``."""
    text = as_column(client).cast("long").cast("string")
    return F.concat(F.coalesce(text, F.lit("NA")), F.lit("-C"))
