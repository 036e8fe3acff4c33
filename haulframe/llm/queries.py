"""The dealt operators as queries over the whole shared tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from haulframe.llm import (
    backtrack,
    bpe,
    divergence,
    extract,
    fingerprint,
    linededup,
    neardup,
    ownership,
    periods,
    posindex,
    quality,
    suffixes,
    warc,
)
from haulframe.llm.common import table


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.version_fingerprints(table(spark, folder, "documents"))


def op2_warc_chain(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_report(spark, folder)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.line_report(table(spark, folder, "documents"))


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.page_report(table(spark, folder, "pages"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(
        table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeat_report(table(spark, folder, "documents"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return ownership.secret_report(table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return posindex.contamination_report(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(table(spark, folder, "documents"), path)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.period_report(table(spark, folder, "documents"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence_report(table(spark, folder, "documents"))


def op13_backtracking_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return backtrack.backtrack_report(table(spark, folder, "documents"), path)


QUERIES = {
    "op1_fingerprints": (op1_fingerprints, None),
    "op2_warc_chain": (op2_warc_chain, warc.SQL),
    "op3_line_dedup": (op3_line_dedup, linededup.SQL),
    "op4_main_text": (op4_main_text, None),
    "op5_quality": (op5_quality, None),
    "op6_repeated_strings": (op6_repeated_strings, None),
    "op7_near_duplicates": (op7_near_duplicates, None),
    "op8_secret_scan": (op8_secret_scan, None),
    "op9_decontamination": (op9_decontamination, posindex.SQL),
    "op10_byte_bpe": (op10_byte_bpe, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_source_divergence": (op12_source_divergence, divergence.SQL),
    "op13_backtracking_bpe": (op13_backtracking_bpe, None),
}
