"""Column headers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def without_spaces(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "") for c in df.columns])


def name_position(df: DataFrame, position: int, name: str) -> DataFrame:
    """Name the column at a 1-based position, for extracts with a blank header."""
    names = list(df.columns)
    names[position - 1] = name
    return df.toDF(*names)


def syntactic(df: DataFrame) -> DataFrame:
    """Headers as plain identifiers: other characters become dots, repeats get a number."""
    names: list[str] = []
    for c in df.columns:
        name = re.sub(r"[^0-9A-Za-z_.]", ".", c) or "X"
        if not re.match(r"[A-Za-z]|\.(?![0-9])", name):
            name = "X" + name
        unique, n = name, 0
        while unique in names:
            n += 1
            unique = f"{name}.{n}"
        names.append(unique)
    return df.toDF(*names)
