"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import embedding_dedup, language_id, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_embedding_near_dedup": embedding_dedup.op5_embedding_near_dedup,
        "op6_poisson_mixing": mixing.op6_poisson_mixing,
        "op6_poisson_mixing_documents": mixing.op6_poisson_mixing_documents,
        "op7_warc_round_trip": warc.op7_warc_round_trip,
        "op8_language_id": language_id.op8_language_id,
        "op9_quality_classifier": quality_classifier.op9_quality_classifier,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_poisson_mixing": mixing.oracle(), "op6_poisson_mixing_documents": mixing.oracle_documents()}
