"""The queries of this subpackage, one an operator, and SQL for those that SQL can express."""

from __future__ import annotations

from lectern.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, periodic_runs, quality, resampling, substring_dedup, token_counts, token_files, url_filter, warc

QUERIES = {
    "op1_curve_packing": packing.op1_curve_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_warc_derivatives": warc.op3_warc_derivatives,
    "op4_quality_divergence": quality.op4_quality_divergence,
    "op5_source_mix": mixing.op5_source_mix,
    "op5_mix_shards": mixing.op5_mix_shards,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_jaccard_join": near_dedup.op8_jaccard_join,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op9_long_line_dedup": line_dedup.op9_long_line_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_token_files": token_files.op13_token_files,
}

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_quality_divergence": quality.OP4_SQL,
    "op5_source_mix": mixing.OP5_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op9_long_line_dedup": line_dedup.OP9_LONG_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_periodic_runs": periodic_runs.OP12_SQL,
}
