"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from winlens.llm import chat_format, decontamination, exact_dedup, filter_audit, language_id, lm_scoring, merkle, near_dedup, ngram_join, pii, prefix_bpe, quality, sharding

QUERIES = {
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op1_pii": pii.op1_pii,
    "op6_language_id": language_id.op6_language_id,
    "op3_quality": quality.op3_quality,
    "op4_sharding": sharding.op4_sharding,
    "op7_bpe": prefix_bpe.op7_bpe,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}

ORACLES = {
    "op5_lm_scoring": lm_scoring.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_chat_format": chat_format.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_ngram_join": ngram_join.SQL,
}
