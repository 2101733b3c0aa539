"""Conditional distinct counts for many metrics in one pass."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 62


@dataclass(frozen=True)
class Metric:
    """Number of distinct ``key`` values among the rows where ``where`` holds."""

    name: str
    key: str
    where: Column
    population: str = "All"


def distinct_counts(rows: DataFrame, metrics: Iterable[Metric]) -> DataFrame:
    """Table ``(population, metric, value)``, one row per metric.

    Each row becomes one bit mask per key column, masks of a key are or-ed, and the
    bits are summed: one scan and one shuffle of (key, mask) for all metrics of a
    key. Rows that count for nothing never reach the shuffle, a hot key shrinks to
    one mask per task, and a missing key counts as one value.
    """
    metrics = list(metrics)
    slots = _slots(metrics)
    groups = sorted({group for group, _ in slots})
    keys = sorted({key for key, _ in groups})
    tests = rows.select(
        *[F.col(key).alias(f"k{i}") for i, key in enumerate(keys)],
        *[m.where.alias(f"w{i}") for i, m in enumerate(metrics)],
    )
    masks = {
        group: " | ".join(
            f"if(w{i}, {1 << bit}L, 0L)" for i, (g, bit) in enumerate(slots) if g == group
        )
        for group in groups
    }
    if len(groups) == 1:
        marks = tests.selectExpr("0 AS kind", "k0 AS key", f"{masks[groups[0]]} AS mask")
    else:
        entries = ", ".join(
            f"struct({i} AS kind, CAST(k{keys.index(key)} AS STRING) AS key, {masks[key, part]} AS mask)"
            for i, (key, part) in enumerate(groups)
        )
        marks = tests.selectExpr(f"inline(array({entries}))")
    per_key = marks.filter("mask != 0").groupBy("kind", "key").agg(F.bit_or("mask").alias("mask"))
    counts = [
        F.expr(f"count_if(kind = {groups.index(group)} AND (mask & {1 << bit}L) != 0) AS m{i}")
        for i, (group, bit) in enumerate(slots)
    ]
    rows = ", ".join(
        f"named_struct('population', {_text(m.population)}, 'metric', {_text(m.name)}, 'value', m{i})"
        for i, m in enumerate(metrics)
    )
    return per_key.agg(*counts).selectExpr(f"inline(array({rows}))")


def _text(value: str) -> str:
    """SQL literal of a label."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _slots(metrics: list[Metric]) -> list[tuple[tuple[str, int], int]]:
    """Key column, mask number and bit of every metric."""
    used: dict[str, int] = {}
    slots = []
    for m in metrics:
        n = used.get(m.key, 0)
        slots.append(((m.key, n // BITS), n % BITS))
        used[m.key] = n + 1
    return slots


def distinct_values(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with missing as a value, as one row with their number."""
    return rows.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n"))


def rows_per(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_pairs_per(rows: DataFrame, member: str, group: str, name: str = "n") -> DataFrame:
    """Number of distinct members under each group value."""
    return rows_per(rows.select(member, group).distinct(), group, name=name)
