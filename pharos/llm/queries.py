"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from pharos.llm import ann, bpe, decontaminate, jaccard_join, langid, pii, suffix_dedup, token_blocks, toxicity, url_filter

QUERIES = {
    "op3_approximate_nearest_neighbours": ann.query,
    "op4_url_filter": url_filter.query,
    "op6_toxicity": toxicity.query,
    "op8_pii_crf": pii.query,
    "op2_language_id": langid.query,
    "op5_byte_level_bpe": bpe.query,
    "op7_token_blocks": token_blocks.query,
    "op1_suffix_array_dedup": suffix_dedup.query,
    "op9_ngram_jaccard_join": jaccard_join.query,
    "op10_benchmark_decontamination": decontaminate.query,
}
SQL = {
    "op1_suffix_array_dedup": suffix_dedup.SQL,
    "op9_ngram_jaccard_join": jaccard_join.SQL,
    "op10_benchmark_decontamination": decontaminate.SQL,
}
