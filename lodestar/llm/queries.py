"""The queries of this folder, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, chaining, chat_format, exact_dedup, license_scan, minhash, packing, quality_rules, suffix_dedup, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": _on("documents", token_counts.token_counts),
        "op2_license_scan": _on("documents", license_scan.scan_licenses),
        "op3_byte_bpe": _on("documents", bpe.encode_documents),
        "op4_suffix_array_dedup": _on("documents", suffix_dedup.repeats),
        "op5_minhash_near_dedup": _on("documents", minhash.near_classes),
        "op6_substring_dedup": _on("documents", chaining.passages),
        "op7_chat_format": _on("conversations", chat_format.format_chats),
        "op8_exact_dedup": _on("documents", exact_dedup.exact_copies),
        "op9_quality_rules": _on("documents", quality_rules.clean),
        "op10_best_fit_packing": _on("documents", packing.pack),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_chat_format": chat_format.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op9_quality_rules": quality_rules.ORACLE,
    }
