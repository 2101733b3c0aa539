"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

The alphabet is words. Patterns of one length share a shift table over blocks of the last words: a block that no pattern
holds lets the search skip to where a pattern could next end. A block with shift zero selects patterns by their suffix
hash, then by the prefix, and the whole window is compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, projected, search_words

WINDOW = 10
BLOCK = 3
#: Patterns of at most so many words are sent to the tasks at once; a larger benchmark takes several passes.
PASS_WORDS = 4_000_000


@dataclass
class WuManber:
    """Patterns of one length in words, with the ids each stands for."""

    length: int
    patterns: dict[tuple[bytes, ...], set] = field(default_factory=dict)

    def prepare(self) -> WuManber:
        self.block = min(BLOCK, self.length)
        self.skip = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[int, dict[bytes, list[tuple[bytes, ...]]]] = {}
        for pattern in self.patterns:
            for end in range(self.block, self.length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.skip), self.length - end)
            suffix = hash(pattern[-self.block :])
            self.buckets.setdefault(suffix, {}).setdefault(pattern[0], []).append(pattern)
        return self

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """Start and ids of every occurrence, overlapping ones included."""
        block, length, skip = self.block, self.length, self.skip
        shift, buckets = self.shift.get, self.buckets
        end, last = length, len(words)
        while end <= last:
            key = tuple(words[end - block : end])
            step = shift(key, skip)
            if step:
                end += step
                continue
            start = end - length
            for pattern in buckets.get(hash(key), {}).get(words[start], ()):
                if tuple(words[start:end]) == pattern:
                    yield start, self.patterns[pattern]
            end += 1


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; fewer words, but not none, are one window."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def machines(items: list[tuple], size: int = WINDOW) -> list[WuManber]:
    """One search for each pattern length among ``(item_id, text)``."""
    by_length: dict[int, WuManber] = {}
    for item_id, text in items:
        for window in windows(search_words(text), size):
            machine = by_length.setdefault(len(window), WuManber(len(window)))
            machine.patterns.setdefault(window, set()).add(item_id)
    return [m.prepare() for m in by_length.values()]


def hits(words: list[bytes], searches: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Merged ``[start, end)`` spans of words that lie in an occurrence, and the ids found."""
    found: set = set()
    spans: list[tuple[int, int]] = []
    for machine in searches:
        for start, ids in machine.occurrences(words):
            found |= ids
            spans.append((start, start + machine.length))
    return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    kept: list[list[int]] = []
    for start, end in sorted(spans):
        if kept and start <= kept[-1][1]:
            kept[-1][1] = max(kept[-1][1], end)
        else:
            kept.append([start, end])
    return [(a, b) for a, b in kept]


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    pass_words: int = PASS_WORDS,
) -> DataFrame:
    """``doc_id, n_words, spans, items`` for every document row.

    ``spans`` are merged word spans ``[start, stop)`` inside occurrences of windows, ``items`` the distinct ids, as
    sorted strings, of items with an occurring window (the text ``null`` stands for a null id). The benchmark is cut by a
    hash of its rows into passes whose patterns have a bounded number of words; each pass goes over all documents, and
    of further passes only the texts with hits are shuffled. Null and empty texts have no words: such documents have no
    spans, such items no windows. Repeated rows are each answered. Empty tables give no rows, or no spans. Other columns
    are ignored.
    """
    named = {"item_column": item_column, "item_text_column": item_text_column}
    given = projected(documents, doc_id=id_column, text=text_column)
    found = _searched(given, benchmark, window, pass_words, **named)
    return found.select("doc_id", "n_words", "spans", "items")


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text", **options) -> DataFrame:
    """The rows of ``documents``, all columns, without any occurrence of a benchmark window."""
    packed = documents.select(F.struct("*").alias("_row"))
    given = packed.select(F.col("_row").alias("doc_id"), F.col(f"_row.`{text_column}`").alias("text"))
    found = _searched(given, benchmark, window, options.pop("pass_words", PASS_WORDS), **options)
    return found.where(F.size("spans") == 0).select("doc_id.*")


def _searched(
    given: DataFrame,
    benchmark: DataFrame,
    window: int,
    pass_words: int,
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """``given`` (``doc_id, text``; the id may be a whole row) with ``n_words, spans, items``."""
    # Repeated rows add no window and no item; without them no hash class of a pass is a copy's alone.
    items = projected(benchmark, item=item_column, text=item_text_column).select(F.col("item").cast("string"), "text")
    items = items.distinct()
    # Each word is in up to `window` patterns, and words take two characters at least with what parts them.
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / 2 * window / pass_words))
    context = given.sparkSession.sparkContext
    held = []
    for number in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == number).collect()
        held.append(context.broadcast([("null" if r[0] is None else r[0], r[1]) for r in part]))
    found = given.withColumn("_hits", _search(held[0], window)("text"))
    if passes == 1:
        return found.select("doc_id", "_hits.n_words", "_hits.spans", "_hits.items")
    # What a text hits depends on the text alone: further passes send on texts with hits, by digest, and copies as one.
    texts = given.select(F.sha2("text", 256).alias("digest"), "text")
    hit = [F.first("spans").alias("spans"), F.first("items").alias("items")]
    further = [_texts_with_hits(texts, h, window).groupBy("digest").agg(*hit) for h in held[1:]]
    more = (
        reduce(DataFrame.union, further)
        .groupBy("digest")
        .agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    )
    found = found.select("doc_id", "_hits", F.sha2("text", 256).alias("own")).join(more, F.col("own") == F.col("digest"), "left")
    spans = F.concat("_hits.spans", F.coalesce("more_spans", F.slice("_hits.spans", 1, 0)))
    items = F.concat("_hits.items", F.coalesce("more_items", F.slice("_hits.items", 1, 0)))
    return found.select(
        "doc_id", "_hits.n_words", _merged(spans).alias("spans"), F.array_sort(F.array_distinct(items)).alias("items")
    )


def _texts_with_hits(texts: DataFrame, held, window: int) -> DataFrame:
    """``digest, spans, items`` of the texts (``digest, text``) in which a pass finds anything."""
    machinery: list = []

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for digest, text in given:
            if not machinery:
                machinery.append(machines(held.value, window))
            spans, ids = hits(search_words(text), machinery[0])
            if spans:
                yield digest, [{"start": a, "stop": b} for a, b in spans], sorted(ids)

    return map_rows(texts, rows, "digest string, spans array<struct<start:int,stop:int>>, items array<string>")


def _merged(spans):
    """Spans in order, those that touch or overlap as one."""
    first = F.slice(spans, 1, 0)
    return F.aggregate(
        F.array_sort(spans),
        first,
        lambda kept, s: F.when(
            (F.size(kept) > 0) & (s["start"] <= F.element_at(kept, -1)["stop"]),
            F.concat(
                F.slice(kept, 1, F.size(kept) - 1),
                F.array(
                    F.struct(
                        F.element_at(kept, -1)["start"].alias("start"),
                        F.greatest(F.element_at(kept, -1)["stop"], s["stop"]).alias("stop"),
                    )
                ),
            ),
        ).otherwise(F.concat(kept, F.array(s))),
    )


def _search(held, window: int):
    machinery: list = []

    @F.pandas_udf("n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>")
    def search(texts: pd.Series) -> pd.DataFrame:
        if not machinery:
            machinery.append(machines(held.value, window))
        rows = []
        for text in texts:
            words = search_words(text)
            spans, found = hits(words, machinery[0])
            rows.append((len(words), [{"start": a, "stop": b} for a, b in spans], sorted(found)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return search


def digest(found: DataFrame) -> DataFrame:
    """Counts and item digest of :func:`contamination`."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + (s.stop - s.start))")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
