"""Sheets of an extract, uploaded assessment tables, and the report sink.

An extract is a folder with one subfolder (or file) per sheet, in CSV or Parquet.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import on_day
from ..functions.missing import as_column
from ..operators.reshape import text_columns
from . import headers, schemas


def read_sheet(
    spark: SparkSession,
    extract: str,
    sheet: str,
    schema: T.StructType | str | None = None,
    *,
    format: str = "parquet",
) -> DataFrame:
    """One named sheet. Give CSV sheets a schema: inference costs a pass over the file."""
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", True).option("nullValue", "NA")
    return reader.load(f"{extract.rstrip('/')}/{sheet}")


def cleaned_sheet(
    df: DataFrame,
    rename: Mapping[str, str] | None = None,
    *,
    dates: Sequence[str] = (),
    key: str | None = None,
    exclude: Sequence = (),
) -> DataFrame:
    """Headers without spaces, canonical names, date columns as days, test records out.

    Excluding also drops rows whose key is missing.
    """
    df = headers.without_spaces(df).withColumnsRenamed(dict(rename or {}))
    if dates:
        df = df.withColumns({c: on_day(c) for c in dates})
    return without_records(df, key, exclude) if key else df


def client_sheet(df: DataFrame) -> DataFrame:
    """The client list of an extract, whose header at one place is blank, under canonical names."""
    named = headers.name_position(df, *schemas.CLIENTS_BLANK_HEADER)
    return cleaned_sheet(named, schemas.CLIENTS, dates=["status_date", "birth_date"])


def without_records(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Rows whose key is known and not one of the given ids."""
    return df.filter(F.col(key).isNotNull() & ~F.col(key).isin(list(ids)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Table of unknown columns; the reader follows from the file name.

    Types are inferred for CSV. Blank text and NA both become missing.
    """
    if "csv" in path.rstrip("/").rsplit("/", 1)[-1].lower():
        options = {"header": True, "inferSchema": True, "nullValue": "NA"}
        return headers.syntactic(spark.read.options(**options).csv(path))
    return spark.read.parquet(path)


def columns_with_values(df: DataFrame, probe: int = 1000) -> list[str]:
    """Names of the columns that hold any value, in order.

    Each round takes a few rows with a value in any column not yet settled, from as few files as give them, and settles at
    least one column, or ends. Only those columns are read, and the last round, which finds none, reads no row group of
    Parquet: the footers say that the columns are null throughout. The answer is exact whatever the size of ``probe``.
    """
    unsettled = list(df.columns)
    while unsettled:
        rows = known_values(df, unsettled).take(probe)
        if not rows:
            break
        hit = [any(column) for column in zip(*rows)]
        unsettled = [c for c, one in zip(unsettled, hit) if not one]
    return [c for c in df.columns if c not in unsettled]


def known_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether each of the columns has a value, for the rows where any has."""
    known = [as_column(c).isNotNull() for c in columns]
    return df.filter(reduce(Column.__or__, known)).select(*[k.alias(f"known{i}") for i, k in enumerate(known)])


def without_empty(df: DataFrame) -> DataFrame:
    """Drops rows with no value at all, then columns with no value.

    Which columns are empty decides the result's schema, so this is looked up at once (``columns_with_values``);
    everything else stays lazy.
    """
    kept = [as_column(c) for c in columns_with_values(df)]
    some = reduce(Column.__or__, [c.isNotNull() for c in kept], F.lit(False))
    return df.select(*kept).filter(some)


def fill_text(df: DataFrame, value: str = "null") -> DataFrame:
    """Missing text becomes a label of its own."""
    return df.withColumns({c: F.coalesce(as_column(c), F.lit(value)) for c in text_columns(df)})


def assessment_table(df: DataFrame) -> DataFrame:
    """An uploaded table made ready for comparison."""
    return fill_text(without_empty(df))


def write_report(report: DataFrame, path: str, *, partition_by: Sequence[str] = ("report",)) -> None:
    """Writes labelled metrics ``(report, population, metric, value)`` to a folder, in place of what is there.

    The report is written beside the folder and takes its place by renaming when it is whole: a job that fails, or
    whose executors are lost, leaves the report that was there, and readers see one or the other.
    """
    spark = report.sparkSession
    path = path.rstrip("/")
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        report.write.partitionBy(*partition_by).parquet(fresh)
        replaced = system.exists(folder)
        if replaced and not system.rename(folder, files.Path(old)):
            raise OSError(f"cannot replace {path}")
        if not system.rename(files.Path(fresh), folder):
            if replaced:
                system.rename(files.Path(old), folder)
            raise OSError(f"cannot write {path}")
        if replaced:
            system.delete(files.Path(old), True)
    finally:
        if system.exists(files.Path(fresh)):
            system.delete(files.Path(fresh), True)
