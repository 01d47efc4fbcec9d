"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from loomwise.llm import align, bpe, decontaminate, divergence, fingerprint, langid, line_dedup, lm_score, near_dup, shards, topk, url_rules, warc


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_language_id": langid.op2_language_id,
        "op3_bpe": bpe.op3_bpe,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_exact_topk": topk.op6_exact_topk,
        "op7_warc": warc.op7_warc,
        "op8_near_dup": near_dup.op8_near_dup,
        "op9_sharding": shards.op9_sharding,
        "op10_url_rules": url_rules.op10_url_rules,
        "op11_token_alignment": align.op11_token_alignment,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_fingerprint": fingerprint.op13_fingerprint,
    }


def oracle_sql() -> dict:
    return {
        "op1_decontaminate": decontaminate.ORACLE_SQL,
        "op4_line_dedup": line_dedup.ORACLE_SQL,
        "op6_exact_topk": topk.ORACLE_SQL,
        "op7_warc": warc.ORACLE_SQL,
        "op8_near_dup": near_dup.ORACLE_SQL,
        "op9_sharding": shards.ORACLE_SQL,
        "op10_url_rules": url_rules.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
    }
