"""The registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from . import (bm25_search, bpe_codec, html_extract, lm_score, lsh_forest, merkle_manifest, mixing, quality, source_audit, suffix_dedup,
               token_count, token_store, url_filter)

REGISTRY = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_bpe_codec": bpe_codec.op2_bpe_codec,
    "op3_quality": quality.op3_quality,
    "op4_bm25_search": bm25_search.op4_bm25_search,
    "op5_lsh_forest": lsh_forest.op5_lsh_forest,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_token_count": token_count.op7_token_count,
    "op8_token_store": token_store.op8_token_store,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_html_extract": html_extract.op12_html_extract,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op4_bm25_search": bm25_search.OP4_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_source_audit": source_audit.OP11_SQL,
    "op13_merkle_manifest": merkle_manifest.OP13_SQL,
}
