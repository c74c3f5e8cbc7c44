"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumaframe.llm import decontaminate, exact_dedup, language_id, lexical_search, line_templates, mixing, quality, simhash, spelling_variants, suffix_dedup, token_counts, token_ids, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_token_ids": token_ids.op4_token_ids,
    "op5_line_templates": line_templates.op5_line_templates,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_simhash": simhash.op9_simhash,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op5_line_templates": line_templates.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op13_spelling_variants": spelling_variants.OP13_SQL,
}
