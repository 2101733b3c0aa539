"""Registered queries of the package: thin forms of the operators over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    attribution,
    chat,
    decontamination,
    html_extraction,
    licenses,
    lines,
    packing,
    quality,
    repair,
    secret_scans,
    simhash,
    spelling,
    training_order,
)
from .common import table


#: A conversation whose texts hold control strings and the escape itself.
TRICKY = (-7, "\\### Assistant: </turn> ok")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from its segments."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv_id, text = TRICKY
    tricky = spark.range(2).select(
        F.lit(conv_id).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return chat.read_back(chat.segments(conversations.unionByName(tricky)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every document and the verdict of its host."""
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept", *(f"rate_{r}" for r in quality.RULES), "host_rules"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extracted(table(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: shingles of 3 words, 3 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the first line, the body and the rest of every document; crossing tokens go by majority."""
    documents = table(spark, sf_dir, "documents")
    return attribution.token_counts(documents, attribution.first_line_and_body(F.col("text")), rule="majority")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages of lines: lines removed, code points and digest of the rest."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = lines.deduplicated(documents, removed_column="n_removed")
    return cleaned.select(
        "doc_id",
        "n_removed",
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token sequence of every document with its slot in the written shards."""
    return training_order.materialised(table(spark, sf_dir, "documents"), key=42)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans and those that the network adds."""
    return secret_scans.digest(secret_scans.findings(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after planted damage; all conversations, also those left empty."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.summary(repair.edits(repair.damaged(conversations)))
    known = conversations.select(F.col("conv_id").alias("id")).distinct()
    joined = known.join(found, known.id.eqNullSafe(found.conv_id), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, empty.get(c, F.lit(0))).alias(c) for c in found.columns if c != "conv_id"),
    )


#: By query: the function, and DuckDB SQL or None.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_quality_rules,
        op3_html_extraction,
        op4_simhash_near_dedup,
        op5_benchmark_decontamination,
        op6_token_counts,
        op7_license_scans,
        op8_line_dedup,
        op9_training_order,
        op10_best_fit_packing,
        op11_secret_scans,
        op12_spelling_variants,
        op13_conversation_repair,
    )
}
