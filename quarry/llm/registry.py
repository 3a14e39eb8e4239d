"""Queries of the llm operators and, where SQL can express them, their oracle texts."""

from __future__ import annotations

from quarry.llm import centroids, chat, decontam, licenses, mixing, neardup, packing, periodic, pii, sharding, token_counts, topk, toxicity

QUERIES = {
    "op1_hash_tree_shards": sharding.query,
    "op2_exact_topk": topk.query,
    "op3_benchmark_decontamination": decontam.query,
    "op4_toxicity": toxicity.query,
    "op5_token_counts": token_counts.query,
    "op6_packing": packing.query,
    "op7_chat_formatting": chat.query,
    "op8_superminhash_groups": neardup.query,
    "op9_disclosive_terms": pii.query,
    "op10_license_alignment": licenses.query,
    "op11_pivotal_mix": mixing.query,
    "op12_rotated_centroids": centroids.query,
    "op13_periodic_runs": periodic.query,
}

ORACLES = {
    "op2_exact_topk": topk.ORACLE,
    "op5_token_counts": token_counts.ORACLE,
    "op12_rotated_centroids": centroids.ORACLE,
}
