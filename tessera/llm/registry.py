"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, html_extraction, language_id, ngram_jaccard, oracles, packing, pii, quality_classifier, quality_rules, resampling, sharding, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.op1,
        "op2_ngram_jaccard": ngram_jaccard.op2,
        "op3_decontamination": decontaminate.op3,
        "op4_pii": pii.op4,
        "op5_bpe": bpe.op5,
        "op6_quality_classifier": quality_classifier.op6,
        "op7_language_id": language_id.op7,
        "op8_sharding": sharding.op8,
        "op9_quality_rules": quality_rules.op9,
        "op10_html_extraction": html_extraction.op10,
        "op11_packing": packing.op11,
        "op12_resampling": resampling.op12,
        "op13_whitening": whitening.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": oracles.OP2, "op3_decontamination": oracles.OP3, "op9_quality_rules": oracles.OP9}
