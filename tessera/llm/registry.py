"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, lm_scoring, near_dedup, quality_classifier, quality_rules, sentencepiece_scan, sharding, token_counts, warc

_OPERATORS = {
    "op1_quality_classifier": quality_classifier,
    "op2_sentencepiece": sentencepiece_scan,
    "op3_language_id": language_id,
    "op4_decontaminate": decontaminate,
    "op5_token_counts": token_counts,
    "op6_warc": warc,
    "op7_sharding": sharding,
    "op8_lm_scoring": lm_scoring,
    "op9_near_dedup": near_dedup,
    "op10_quality_rules": quality_rules,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _OPERATORS.items()} | {"language_id_pages": language_id.pages_query}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _OPERATORS.items() if getattr(module, "SQL", None)}
