"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import lines, mixing, packing, pii, simhash, spans, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_personal_data": pii.op4_personal_data,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_token_binary": packing.op6_token_binary,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_embedding_near_dedup": vectors.op8_embedding_near_dedup,
    "op9_exact_top_k": vectors.op9_exact_top_k,
    "op10_substring_dedup": spans.op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": mixing.SQL,
    "op8_embedding_near_dedup": vectors.NEAR_SQL,
    "op9_exact_top_k": vectors.TOP_K_SQL,
}
