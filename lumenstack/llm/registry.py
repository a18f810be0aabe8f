"""The queries of this subpackage, their SQL, and the pipeline's, for `__spark_entry__.py`."""

from __future__ import annotations

from . import align, bpe, chat_format, chat_repair, classifier, ngram_join, packing, pii, quality_rules, sharding, suffix_dedup, token_count, topk


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_packing": packing.op5_packing,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_bpe": bpe.op7_bpe,
        "op8_pii": pii.op8_pii,
        "op9_quality_classifier": classifier.op9_quality_classifier,
        "op10_exact_topk": topk.op10_exact_topk,
        "op11_token_counts": token_count.op11_token_counts,
        "op12_chat_repair": chat_repair.op12_chat_repair,
        "op13_alignment": align.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": suffix_dedup.ORACLE, "op3_chat_format": chat_format.ORACLE, "op4_quality_rules": quality_rules.ORACLE,
        "op6_ngram_join": ngram_join.ORACLE, "op10_exact_topk": topk.ORACLE, "op12_chat_repair": chat_repair.ORACLE,
    }
