"""Queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyforge.llm import op01_urls, op02_simhash, op03_language, op04_scoring, op05_packing, op06_contamination, op07_rules, op08_shards, op09_quality, op10_substrings

QUERIES = {
    "op1_url_filter": op01_urls.op1_url_filter,
    "op2_simhash_dedup": op02_simhash.op2_simhash_dedup,
    "op3_compression_language_id": op03_language.op3_compression_language_id,
    "op4_masked_pseudo_likelihood": op04_scoring.op4_masked_pseudo_likelihood,
    "op5_sum_of_squares_packing": op05_packing.op5_sum_of_squares_packing,
    "op6_benchmark_decontamination": op06_contamination.op6_benchmark_decontamination,
    "op7_isolation_rules": op07_rules.op7_isolation_rules,
    "op8_external_shuffle": op08_shards.op8_external_shuffle,
    "op9_line_crf_quality": op09_quality.op9_line_crf_quality,
    "op10_substring_dedup": op10_substrings.op10_substring_dedup,
}

ORACLES = {
    "op1_url_filter": op01_urls.ORACLE,
    "op6_benchmark_decontamination": op06_contamination.ORACLE,
    "op10_substring_dedup": op10_substrings.ORACLE,
}
