"""Shared helpers: projected inputs, Arrow batches, word rules, durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes outside [0-9a-z\x80-\xff] become blanks, A-Z lower-case: the word rule of searches.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def search_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case; null has none."""
    return text.encode().translate(WORD_TABLE).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts exactly at these six bytes."""
    return text.encode().split() if text else []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def projected(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names; others cannot clash with its results."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def map_rows(
    df: DataFrame, function: Callable[..., Iterator[tuple]], schema: str, rows: int = 4096, arrow_in: bool = False
) -> DataFrame:
    """Applies a generator ``function(rows) -> tuples`` within tasks, Arrow batch by Arrow batch.

    Input comes as tuples, or with ``arrow_in`` as record batches. Output is flushed every ``rows`` tuples, so that
    memory is bounded by one batch and not by the partition.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        held: list[tuple] = []
        size = 0
        for row in function(batches if arrow_in else given()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(held) >= rows or size >= 8 << 20:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str) -> DataFrame:
    """Applies a generator from Arrow batches to lists of whole columns (arrays or sequences) within tasks."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without the setting, as in tests, gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def durable(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows as a written table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder, compression=compression)
    return spark.read.schema(df.schema).parquet(folder)
