"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bloom_lm, dart_minhash, decontaminate, line_mphf, media_chunks, sentencepiece_backend, suffix_family, token_ids, toxicity, trie_counts


def queries() -> dict:
    return {
        "op1_token_ids": token_ids.op1_token_ids,
        "op2_near_dedup": dart_minhash.op2_near_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_media_chunks": media_chunks.op4_media_chunks,
        "op5_suffix_dedup": suffix_family.op5_suffix_dedup,
        "op6_lm_score": bloom_lm.op6_lm_score,
        "op7_line_dedup": line_mphf.op7_line_dedup,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_sentencepiece": sentencepiece_backend.op9_sentencepiece,
        "op10_token_counts": trie_counts.op10_token_counts,
    }


def oracle_sql() -> dict:
    return {"op2_near_dedup": dart_minhash.OP2_SQL, "op5_suffix_dedup": suffix_family.OP5_SQL, "op7_line_dedup": line_mphf.OP7_SQL, "op8_decontaminate": decontaminate.OP8_SQL}
