"""Queries of the training-data operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, conversations, decontaminate, jaccard_join, license_scan, packing, pii, quality_classifier, quality_rules, sharding, substring_dedup, warc, whitening


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_sharding": sharding.op7_sharding,
        "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
        "op9_warc": warc.op9_warc,
        "op10_pii": pii.op10_pii,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_chat_formatting": chat_format.op13_chat_formatting,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": warc.ORACLE_SQL}
