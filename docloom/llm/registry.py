"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import op1_mixing, op2_token_counts, op3_topk, op4_token_files, op5_ngram_join, op6_license_scan, op7_byte_bpe, op8_sharding, op9_toxicity, op10_media, op11_periodic_runs, op12_embedding_dedup, op13_conversation_repair

QUERIES = {
    "op1_mixing": op1_mixing.op1_mixing,
    "op2_token_counts": op2_token_counts.op2_token_counts,
    "op3_topk": op3_topk.op3_topk,
    "op4_token_files": op4_token_files.op4_token_files,
    "op5_ngram_join": op5_ngram_join.op5_ngram_join,
    "op6_license_scan": op6_license_scan.op6_license_scan,
    "op7_byte_bpe": op7_byte_bpe.op7_byte_bpe,
    "op8_sharding": op8_sharding.op8_sharding,
    "op9_toxicity": op9_toxicity.op9_toxicity,
    "op10_media": op10_media.op10_media,
    "op11_periodic_runs": op11_periodic_runs.op11_periodic_runs,
    "op12_embedding_dedup": op12_embedding_dedup.op12_embedding_dedup,
    "op13_conversation_repair": op13_conversation_repair.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk": op3_topk.ORACLE,
    "op5_ngram_join": op5_ngram_join.ORACLE,
    "op6_license_scan": op6_license_scan.ORACLE,
    "op12_embedding_dedup": op12_embedding_dedup.ORACLE,
}
