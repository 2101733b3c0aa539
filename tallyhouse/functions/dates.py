"""Dates and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ColumnLike, as_column


def day(text: str) -> Column:
    """Date literal from ``yyyymmdd`` text."""
    return F.to_date(F.lit(text), "yyyyMMdd")


def on_day(c: ColumnLike) -> Column:
    """Calendar day of a date or timestamp."""
    return as_column(c).cast("date")


def in_window(c: ColumnLike, start: Column, end: Column) -> Column:
    """Inclusive window of whole days: a time on the last day is inside."""
    return on_day(c).between(start, end)


def completed_years(born: ColumnLike, at: ColumnLike) -> Column:
    """Age in completed years; a 29 February birthday falls on 1 March in common years."""

    def stamp(c: Column) -> Column:
        return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)

    return F.floor((stamp(as_column(at)) - stamp(as_column(born))) / 10000).cast("int")
