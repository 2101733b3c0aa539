"""Quality rules of documents, and of hosts through rates shrunk with an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_rows, projected

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A host goes if its shrunk failure rate is above this and the host is large enough to have shown it.
MAX_HOST_RATE = 0.8
#: Weight in documents of the prior if host rates vary no more than chance, or only one host is there.
MAX_PRIOR_WEIGHT = 1000.0
#: Bytes of host names and rates up to which they are broadcast; more are joined by a shuffle on the host.
BROADCAST_BYTES = 32 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SHORT, _REPETITIVE = f"n_words < {MIN_WORDS}", f"100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"
#: Rules counted by host, in SQL over ``COUNTS``: what a document fails. ``base`` decides on documents too, the others,
#: a symbol or a repeated line for every ten words, only on hosts that show them throughout.
RULES = {
    "base": f"{_SHORT} OR {_REPETITIVE}",
    "short": _SHORT,
    "repetitive": _REPETITIVE,
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > n_words",
}


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    key = ids[:n]
    for i in range(1, size):
        key = key * len(number) + ids[i : i + n]
        # Ranks keep the key small whatever the number of distinct words.
        if i < size - 1 and len(number) ** (i + 2) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(n, dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for i in range(size):
        covered[i : i + n] |= repeated
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of one text; null has no words."""
    raw = text.encode() if text else b""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(b"".join(words).decode()),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
) -> DataFrame:
    """``doc_id, host``, the five counts and ``base_failed`` for every row, without a shuffle."""

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, host, text in given:
            yield (doc_id, host, *measures(text))

    kinds = dict(documents.dtypes)
    schema = f"doc_id {kinds[id_column]}, host {kinds[host_column]}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return map_rows(projected(documents, doc_id=id_column, host=host_column, text=text_column), rows, schema).withColumn(
        "base_failed", F.expr(RULES["base"])
    )


def host_rates(rows: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, n_docs``, ``failed_R`` and ``rate_R`` for each rule R, and ``host_rules`` of ``measured`` rows with a host.

    Each rule has a beta prior of its own: the documents' failure rate is its mean; its weight comes from the moments of
    the host rates: their variance beyond binomial chance. Rates are ``(failed + weight * mean) / (n_docs + weight)``.
    ``host_rules`` names the rules, in the order of ``RULES``, whose rate is above ``max_host_rate``; a host with any goes.
    """
    hosts = (
        rows.where("host IS NOT NULL")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            *(F.sum(F.expr(f"cast({rule} AS bigint)")).alias(f"failed_{r}") for r, rule in RULES.items()),
        )
    )
    totals = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n_docs").alias("docs"),
        F.sum((F.col("n_docs") * F.col("n_docs")).cast("decimal(38,0)")).alias("sizes"),
        *(F.sum(f"failed_{r}").alias(f"failed_{r}") for r in RULES),
        # Decimal sums do not depend on the order of the rows.
        *(F.sum((F.col(f"failed_{r}") * F.col(f"failed_{r}") / F.col("n_docs")).cast("decimal(38,12)")).alias(f"squares_{r}") for r in RULES),
    )
    prior = []
    for r in RULES:
        mean = F.col(f"failed_{r}") / F.col("docs")
        # Variance components: sum n (p - mean)^2 = (hosts - 1) mean (1 - mean) + (N - sum n^2 / N) between.
        chance = mean * (1 - mean)
        spread = F.col(f"squares_{r}").cast("double") - F.col("docs") * mean * mean
        between = (spread - (F.col("hosts") - 1) * chance) / (F.col("docs") - F.col("sizes").cast("double") / F.col("docs"))
        weight = F.when((F.col("hosts") > 1) & (between > 0), F.greatest(F.lit(1.0), F.least(F.lit(MAX_PRIOR_WEIGHT), chance / between - 1)))
        prior += [mean.alias(f"mean_{r}"), F.coalesce(weight, F.lit(MAX_PRIOR_WEIGHT)).alias(f"weight_{r}")]

    def rate(r: str) -> Column:
        weight = F.col(f"weight_{r}")
        return F.round((F.col(f"failed_{r}") + weight * F.col(f"mean_{r}")) / (F.col("n_docs") + weight), 9)

    # One row: the join has a side of proven size.
    rated = hosts.join(F.broadcast(totals.select(*prior))).select(
        "host", "n_docs", *(f"failed_{r}" for r in RULES), *(rate(r).alias(f"rate_{r}") for r in RULES)
    )
    above = F.array_compact(F.array(*(F.when(F.col(f"rate_{r}") > max_host_rate, F.lit(r)) for r in RULES)))
    return rated.withColumn("host_rules", F.array_join(above, ","))


def judged(
    documents: DataFrame,
    max_host_rate: float = MAX_HOST_RATE,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
) -> DataFrame:
    """``doc_id, host``, counts, ``base_failed``, ``rate_R`` for each rule R, ``host_rules`` and ``kept`` for every row.

    ``kept`` is false for a failed document, and for every document of a host that fails any of ``RULES`` at a shrunk rate
    above ``max_host_rate``; ``host_rules`` names them. Failures are counted by host with map-side combine; the verdicts, one
    row for each host, are written and their size taken: up to ``BROADCAST_BYTES`` they are broadcast, so that no row moves
    and a hot host stays spread; more are joined on the host, whose hot side adaptive execution can split. A null host has
    no rate and no verdict. Null and empty texts have no words and fail. Repeated rows each count. Empty tables give no rows.
    """
    rows = durable(measured(documents, id_column, text_column, host_column))
    rates = host_rates(rows, max_host_rate).withColumnRenamed("host", "rated_host").drop("n_docs", *(f"failed_{r}" for r in RULES))
    rates = _sized(durable(rates), "rated_host")
    return (
        rows.join(rates, F.col("host") == F.col("rated_host"), "left")
        .drop("rated_host")
        .withColumn("host_rules", F.coalesce("host_rules", F.lit("")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("host_rules") == ""))
    )


def _sized(hosts: DataFrame, name: str) -> DataFrame:
    """Rows of hosts, to be broadcast if their names and 100 bytes for each row stay within ``BROADCAST_BYTES``."""
    size = hosts.agg(F.sum(F.length(F.col(name).cast("string").cast("binary")).cast("bigint") + 100)).first()[0] or 0
    return F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts


def kept_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that :func:`judged` keeps, with all their columns.

    The verdict on a row follows from its own text and its host's rate, so only the rejected hosts are joined to the
    documents and the rows themselves are measured where they are. Their size is taken first: up to
    ``BROADCAST_BYTES`` they are broadcast, so that no document moves; more are joined by a shuffle on the host.
    """
    host, text = options.get("host_column", "source"), options.get("text_column", "text")
    limit = options.get("max_host_rate", MAX_HOST_RATE)
    rows = measured(documents, options.get("id_column", "doc_id"), text, host)
    rejected = durable(host_rates(rows, limit).where("host_rules != ''").select(F.col("host").alias("_rejected_host")))
    rejected = _sized(rejected, "_rejected_host")

    @F.pandas_udf("boolean")
    def passes(texts):
        return texts.map(lambda t: not base_failed(t)).astype(bool)

    packed = documents.select(F.struct("*").alias("_row"))
    good = packed.where(passes(F.col(f"_row.`{text}`")))
    # An anti join that finds no host keeps a null host.
    return good.join(rejected, F.col(f"_row.`{host}`") == F.col("_rejected_host"), "left_anti").select("_row.*")


def base_failed(text: str | None) -> bool:
    n_words, *_, repeated = measures(text)
    return n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n_words
