"""The queries of this subpackage, and their DuckDB texts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkroll.llm import alignment, bpe, decontaminate, html, language, lm, negatives, quality, sharding, simhash, sketch, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": sketch.op1_fingerprints,
    "op2_language_id": language.op2_language_id,
    "op3_simhash": simhash.op3_simhash,
    "op4_kd_shards": sharding.op4_kd_shards,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_html_text": html.op6_html_text,
    "op7_quality": quality.op7_quality,
    "op8_deleted_interpolation": lm.op8_deleted_interpolation,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_bpe": bpe.op10_bpe,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLES: dict[str, str] = {"op11_hard_negatives": negatives.ORACLE}
