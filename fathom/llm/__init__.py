"""Operators of a training-data pipeline; nothing else in the library imports them."""

from __future__ import annotations

from fathom.llm import attribution, byte_bpe, centroid_clusters, language_id, license_scans, line_dedup, near_dedup, packing, quality_rules, source_mixing, token_counts, topk_search, url_filters

QUERIES = {
    "op1_topk_search": topk_search.query,
    "op2_quality_rules": quality_rules.query,
    "op3_language_id": language_id.query,
    "op4_line_dedup": line_dedup.query,
    "op5_near_dedup": near_dedup.query,
    "op6_url_filters": url_filters.query,
    "op7_token_counts": token_counts.query,
    "op8_source_mixing": source_mixing.query,
    "op9_license_scans": license_scans.query,
    "op10_best_fit_packing": packing.query,
    "op11_attribution": attribution.query,
    "op12_byte_bpe": byte_bpe.query,
    "op13_centroid_clusters": centroid_clusters.query,
    # What SQL can say of operators that it can't express as a whole: the same results, fewer columns.
    "quality_base_columns": quality_rules.base_columns,
    "token_word_totals": token_counts.word_totals,
    "mixing_shared_columns": source_mixing.shared_columns,
    "license_base_columns": license_scans.base_columns,
}

ORACLES = {
    "op1_topk_search": topk_search.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_near_dedup": near_dedup.ORACLE,
    "op6_url_filters": url_filters.ORACLE,
    "op11_attribution": attribution.ORACLE,
    "op13_centroid_clusters": centroid_clusters.ORACLE,
    "quality_base_columns": quality_rules.BASE_ORACLE,
    "token_word_totals": token_counts.WORD_ORACLE,
    "mixing_shared_columns": source_mixing.SHARED_ORACLE,
    "license_base_columns": license_scans.BASE_ORACLE,
}
