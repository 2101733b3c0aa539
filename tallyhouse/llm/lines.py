"""Line de-duplication by content-defined chunks of lines.

A rolling hash over the hashes of the last lines marks boundary lines, so boundaries move with the text and a passage of
several lines is marked alike wherever it stands. From every line a chunk reaches on to the next boundary line, and one
back to the last: so the chunks of a repeated run cover it from its first to its last line, however it is embedded. Chunks
that stand elsewhere in the corpus before, byte for byte, are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_rows, projected

#: Lines in the rolling window; one line in so many is no boundary; lines of a chunk at most.
WINDOW = 2
SPARSE = 8
MOST_LINES = 16

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def boundaries(lines: list[str], window: int = WINDOW, sparse: int = SPARSE) -> list[bool]:
    """Whether each line is a boundary: by a polynomial over the hashes of the last ``window`` lines."""
    marks, rolled = [], 0
    top = pow(_BASE, window, 1 << 64)
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    for i, value in enumerate(hashes):
        rolled = (rolled * _BASE + value) & _MASK
        if i >= window:
            rolled = (rolled - hashes[i - window] * top) & _MASK
        marks.append((rolled >> 32) % sparse != 0)
    return marks


def chunks(lines: list[str], window: int = WINDOW, sparse: int = SPARSE, most: int = MOST_LINES) -> list[tuple[int, int]]:
    """``[first, stop)`` of all chunks, of two to ``most`` lines that are not blank, with blank ones between.

    A chunk reaches from a line to the next boundary line after it, or from the last boundary line before a line to it;
    the ends of the text, and ``most`` lines, end a chunk as well, so that equal lines give no long ones.
    """
    full = [i for i, line in enumerate(lines) if line.strip()]
    marks = boundaries([lines[i] for i in full], window, sparse)
    last = len(full) - 1
    found = set()
    after = last
    for k in range(last - 1, -1, -1):
        if marks[k + 1]:
            after = k + 1
        found.add((full[k], full[min(after, k + most - 1)] + 1))
    before = 0
    for k in range(1, last + 1):
        if marks[k - 1]:
            before = k - 1
        found.add((full[max(before, k - most + 1)], full[k] + 1))
    return sorted(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of lines in order, those that overlap or touch as one."""
    kept: list[tuple[int, int]] = []
    for first, stop in sorted(spans):
        if kept and first <= kept[-1][1]:
            kept[-1] = (kept[-1][0], max(kept[-1][1], stop))
        else:
            kept.append((first, stop))
    return kept


def _keyed(documents: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """``doc_id, text`` and a hash of the text: rows that agree in all are one document."""
    return projected(documents, doc_id=id_column, text=text_column).withColumn("text_key", F.xxhash64("text"))


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _hash(line: str, bits: int) -> int:
    """The upper bits of a line's hash, signed."""
    value = xxhash.xxh64_intdigest(line) >> (64 - bits)
    return value - (1 << 64) if value >> 63 else value


def ambiguous_hashes(documents: DataFrame, text_column: str = "text", hash_bits: int = 64) -> list[int]:
    """Hashes that two different lines of the corpus share: lines are compared byte for byte, copies folded before.

    Of n different lines about n * n / 2 ** 65 share theirs: a handful among 10 ** 10.
    """

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in given:
            for line in {*_lines(text)}:
                yield _hash(line, hash_bits), line

    known = map_rows(projected(documents, text=text_column), rows, "hash bigint, line string")
    shared = known.groupBy("hash", "line").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("lines"))
    return [row["hash"] for row in shared.where("lines > 1").collect()]


def line_chunks(
    documents: DataFrame,
    window: int = WINDOW,
    sparse: int = SPARSE,
    id_column: str = "doc_id",
    text_column: str = "text",
    hash_bits: int = 64,
) -> DataFrame:
    """``doc_id, text_key, first, stop, chunk`` of all chunks; ``chunk`` is equal for equal bytes, and only for those.

    It holds the hashes of the chunk's lines, and after a hash that several lines share the line itself. Null texts have
    no lines.
    """
    ambiguous = frozenset(ambiguous_hashes(documents, text_column, hash_bits))

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, key in given:
            lines = _lines(text)
            names = []
            for line in lines:
                value = _hash(line, hash_bits)
                name = value.to_bytes(8, "little", signed=True)
                if value in ambiguous:
                    raw = line.encode()
                    name += len(raw).to_bytes(8, "little") + raw
                names.append(name)
            for first, stop in chunks(lines, window, sparse):
                yield doc_id, key, first, stop, b"".join(names[first:stop])

    kind = dict(documents.dtypes)[id_column]
    schema = f"doc_id {kind}, text_key bigint, first int, stop int, chunk binary"
    return map_rows(_keyed(documents, text_column, id_column), rows, schema)


def removals(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, text_key, first, stop`` of every chunk that stands elsewhere before.

    An earlier place that shares lines with it does not count, so three equal lines are not a repeated passage.
    """
    found = line_chunks(documents, **options)
    place = F.struct("doc_id", "text_key", "first", "stop")
    # Copies of a hot chunk are folded before the shuffle.
    repeated = durable(
        found.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")).where("n > 1").drop("n")
    )
    own = F.col("doc_id").eqNullSafe(F.col("place.doc_id")) & (F.col("text_key") == F.col("place.text_key"))
    return (
        found.join(repeated, "chunk")
        .where(~(own & (F.col("first") < F.col("place.stop"))))
        .select("doc_id", "text_key", "first", "stop")
    )


def _merged(spans: str) -> Column:
    @F.pandas_udf("array<struct<first:int,stop:int>>")
    def run(given: pd.Series) -> pd.Series:
        return given.map(lambda own: [{"first": a, "stop": b} for a, b in merged([(g["first"], g["stop"]) for g in own])])

    return run(spans)


def _left(text: Column, gone: Column) -> Column:
    """The text without the lines of the spans, in one walk over both."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, own):
            if text is None or own is None:
                return text
            lines, kept, at = text.split("\n"), [], 0
            for span in own:
                kept += lines[at : span["first"]]
                at = span["stop"]
            return "\n".join(kept + lines[at:])

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    return run(text, gone)


def _merged(spans: str) -> Column:
    @F.pandas_udf("array<struct<first:int,stop:int>>")
    def run(given: pd.Series) -> pd.Series:
        return given.map(lambda own: [{"first": a, "stop": b} for a, b in merged([(g["first"], g["stop"]) for g in own])])

    return run(spans)


def deduplicated(
    documents: DataFrame,
    window: int = WINDOW,
    sparse: int = SPARSE,
    id_column: str = "doc_id",
    text_column: str = "text",
    count_column: str | None = None,
    removed_column: str | None = None,
    hash_bits: int = 64,
) -> DataFrame:
    """``documents`` with repeated multi-line passages taken out of the text; all rows and columns stay.

    A passage is a run of chunks that stand elsewhere before; blank lines around it stay, and so does the first
    occurrence of every chunk, by id, text hash and line. Rows that agree in id and text are one document and lose
    the same lines. A null id sorts first; null texts stay null, empty ones empty, and a text may become empty.
    ``count_column`` names a column to set to the new number of code points, if given and present; ``removed_column``
    one to add with the number of lines removed, in place of a column of that name. Other columns may have any name.
    Empty tables give no rows.
    """
    options = {"window": window, "sparse": sparse, "id_column": id_column, "text_column": text_column, "hash_bits": hash_bits}
    gone = (
        removals(documents, **options)
        .groupBy("doc_id", "text_key")
        # One document's own chunks: bounded by its text.
        .agg(F.collect_set(F.struct("first", "stop")).alias("gone"))
        .select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), _merged("gone").alias("gone"))
    )
    text = f"_row.`{text_column}`"
    packed = documents.select(F.struct("*").alias("_row")).withColumn("_key", F.xxhash64(text))
    joined = packed.join(
        gone, F.col(f"_row.`{id_column}`").eqNullSafe(F.col("gone_id")) & (F.col("_key") == F.col("gone_key")), "left"
    )
    # Only texts that lose lines are split.
    new = F.when(F.col("gone").isNull(), F.col(text)).otherwise(_left(F.when(F.col("gone").isNotNull(), F.col(text)), F.col("gone")))
    cleaned = joined.select("_row", "gone", new.alias("_new"))
    out = []
    for field in documents.columns:
        if field == text_column:
            out.append(F.col("_new").alias(field))
        elif field == count_column:
            out.append(F.coalesce(F.length("_new"), F.lit(0)).cast(dict(documents.dtypes)[field]).alias(field))
        elif field != removed_column:
            out.append(F.col(f"_row.`{field}`").alias(field))
    if removed_column:
        removed = F.aggregate("gone", F.lit(0), lambda n, g: n + g["stop"] - g["first"])
        out.append(F.coalesce(removed, F.lit(0)).cast("bigint").alias(removed_column))
    return cleaned.select(*out)
