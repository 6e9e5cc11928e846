"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from fieldledger.llm import (
    bpe,
    exact_dedup,
    licenses,
    near_dedup,
    packing,
    passages,
    phrases,
    quality,
    repair,
    secrets,
    shards,
    url_filter,
    vectors,
)

QUERIES = {
    "op1_substring_dedup": passages.op1_substring_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_packing": packing.op5_packing,
    "op6_licenses": licenses.op6_licenses,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_embedding_near_dedup": vectors.op8_embedding_near_dedup,
    "op9_quality": quality.op9_quality,
    "op10_secrets": secrets.op10_secrets,
    "op11_phrases": phrases.op11_phrases,
    "op12_sharding": shards.op12_sharding,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

ORACLES = {
    "op4_url_filter": url_filter.OP4_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_phrases": phrases.OP11_SQL,
}
