"""Token counts of parts of documents: each document is encoded once, its tokens are attributed by their offsets.

Token spans in code points are joined to the spans of fields or sections as intervals; a token that crosses a boundary,
or covers no section wholly, goes by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, projected
from .tokens import vocabulary

#: ``majority``: the section with most of the token's characters, the first of equals. ``start``: the section of its first
#: character. ``split``: each section gets the share of the characters it has.
RULES = ("majority", "start", "split")
_LOADED: dict[str, ByteTokens] = {}


class ByteTokens:
    """A byte-level vocabulary: tokens are byte strings, so their lengths add up to the text's bytes."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, number in ranks.items():
            self.lengths[number] = len(token)

    def spans(self, text: str) -> np.ndarray:
        """``(n, 2)`` code point spans of all tokens. A token that ends inside a character covers it, as does the next."""
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        stops = np.cumsum(self.lengths[ids])
        starts = stops - self.lengths[ids]
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        if len(raw) != len(text):
            heads = np.cumsum((raw & 0xC0) != 0x80)  # number of characters begun up to each byte
            starts, stops = heads[starts] - 1, heads[stops - 1]
        return np.stack([starts, stops], axis=1)


def byte_tokens(path: str) -> ByteTokens:
    if path not in _LOADED:
        _LOADED[path] = ByteTokens(path)
    return _LOADED[path]


def attributed(tokens: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; sections are ``[start, stop)``, in order, and do not overlap. The last entry is the rest.

    An interval join of two sorted lists: each token meets the sections from the one that holds its start to the one that
    holds its end. What lies in no section counts towards the rest.
    """
    counts = np.zeros(len(sections) + 1)
    if not len(tokens):
        return counts
    # The gaps between sections, and before and after them, are intervals too.
    edges = np.unique(np.concatenate([sections.reshape(-1), [0, tokens[-1, 1]]]).astype(np.int64))
    owner = np.full(len(edges), len(sections))
    nonempty = np.flatnonzero(sections[:, 1] > sections[:, 0]) if len(sections) else np.array([], dtype=int)
    if len(nonempty):
        owner[np.searchsorted(edges, sections[nonempty, 0])] = nonempty
    first = np.searchsorted(edges, tokens[:, 0], side="right") - 1
    last = np.searchsorted(edges, tokens[:, 1] - 1, side="right") - 1
    inside = (first == last) | (rule == "start")
    np.add.at(counts, owner[first[inside]], 1)
    for token, a, b in zip(tokens[~inside], first[~inside], last[~inside]):
        bounds = np.clip(np.append(edges[a : b + 1], token[1]), token[0], token[1])
        shares = np.diff(bounds)
        if rule == "majority":
            counts[owner[a + int(np.argmax(shares))]] += 1
        else:
            np.add.at(counts, owner[a : b + 1], shares / shares.sum())
    return counts


def token_counts(
    documents: DataFrame,
    sections: Column,
    tokenizer: str | None = None,
    rule: str = "majority",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, section, start, stop, n_tokens`` for every section of every row, and one row ``rest`` for what is outside.

    ``sections`` is an ``array<struct<name:string,start:int,stop:int>>`` over the document's columns: code point spans in
    order that do not overlap. Spans are clipped to the text; null spans or names are dropped. A section may be empty and
    has no tokens then. The rest is given for every document, so counts add up to the document's tokens. Null and empty
    texts have no tokens. Repeated rows are each counted. Empty tables give no rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = tokenizer or vocabulary("byte_bpe_50k.tiktoken")
    kind = dict(documents.dtypes)[id_column]
    given = documents.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"), sections.alias("sections")
    )

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        encoder = byte_tokens(path)
        for doc_id, text, found in given:
            text = text or ""
            named = [
                (s["name"], min(max(s["start"], 0), len(text)), min(max(s["stop"], 0), len(text)))
                for s in found or []
                if s and None not in (s["name"], s["start"], s["stop"])
            ]
            spans = np.array([(a, max(a, b)) for _, a, b in named], dtype=np.int64).reshape(-1, 2)
            counts = attributed(encoder.spans(text), spans, rule).tolist()
            for (name, _, _), (a, b), n in zip(named, spans.tolist(), counts):
                yield doc_id, name, a, b, n
            yield doc_id, "rest", 0, len(text), counts[-1]

    counted = map_rows(given, rows, f"doc_id {kind}, section string, start bigint, stop bigint, n_tokens double")
    return counted if rule == "split" else counted.withColumn("n_tokens", F.col("n_tokens").cast("bigint"))


def first_line_and_body(text: Column) -> Column:
    """Sections ``lead``, the first line without its end, and ``body``, all after it."""
    size = F.coalesce(F.length(text), F.lit(0))
    at = F.coalesce(F.instr(text, "\n"), F.lit(0))
    lead = F.when(at > 0, at - 1).otherwise(size)

    def span(name: str, start: Column, stop: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))

    # The line's end belongs to neither.
    return F.array(span("lead", F.lit(0), lead), span("body", F.least(lead + 1, size), size))
