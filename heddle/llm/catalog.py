"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe_count, bpe_duckdb, curve_neighbours, exact_dedup, importance, jaccard_join, langid, line_dedup, packing, periodic_runs, quality_rules, token_alignment, wrappers

QUERIES = {
    "op1_importance_resampling": importance.query,
    "op2_best_fit_packing": packing.query,
    "op3_html_main_text": wrappers.query,
    "op4_shingle_jaccard_join": jaccard_join.query,
    "op5_fuzzy_line_dedup": line_dedup.query,
    "op6_language_id": langid.query,
    "op7_byte_bpe_codec": bpe_duckdb.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_quality_rules": quality_rules.query,
    "op10_token_counts": bpe_count.query,
    "op11_token_alignment": token_alignment.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_curve_neighbours": curve_neighbours.query,
}

SQL = {
    "op8_exact_dedup": exact_dedup.SQL,
}
