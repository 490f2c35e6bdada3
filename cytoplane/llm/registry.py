"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, embedding_dedup, fill_in_middle, filter_audit, language_id, license_scan, line_dedup, minhash, secret_scan, sharding, token_count, toxicity


def queries() -> dict:
    return {
        "op1_minhash_dedup": minhash.op1_minhash_dedup,
        "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_language_id": language_id.op5_language_id,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_token_count": token_count.op7_token_count,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_bpe": bpe.op9_bpe,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict:
    return {
        "op1_minhash_dedup": minhash.ORACLE,
        "op2_embedding_dedup": embedding_dedup.ORACLE,
        "op3_line_dedup": line_dedup.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op12_fill_in_middle": fill_in_middle.ORACLE,
        "op13_sharding": sharding.ORACLE,
    }
