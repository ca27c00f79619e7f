"""The operators' queries, with their production parameters, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, language_id, mixing, ngram_join, quality, sharding, suffix_tree_lm, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": ngram_join.query,
        "op2_embedding_near_duplicates": embedding_dedup.query,
        "op3_benchmark_decontamination": decontaminate.query,
        "op4_suffix_tree_scoring": suffix_tree_lm.query,
        "op5_quality_classifier": quality.query,
        "op6_url_filter": url_filter.query,
        "op7_language_id": language_id.query,
        "op8_toxicity": toxicity.query,
        "op9_source_mixing": mixing.query,
        "op10_feistel_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_source_mixing": mixing.SQL,
        "op10_feistel_sharding": sharding.SQL,
    }
