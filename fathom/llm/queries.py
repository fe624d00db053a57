"""The registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from fathom.llm import decontaminate, license_scan, line_dedup, oracle, packing, quality_cnn, quality_rules, simhash, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_quality_divergence": quality_rules.op1_quality_divergence,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_cnn": quality_cnn.op3_quality_cnn,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_packing": packing.op5_packing,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_simhash": simhash.op7_simhash,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_license_scan": license_scan.op10_license_scan,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {"op1_quality_divergence": oracle.QUALITY, "op4_line_dedup": oracle.LINES, "op6_decontaminate": oracle.LEAKS, "op7_simhash": oracle.SIMHASH}
