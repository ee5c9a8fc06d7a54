"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup, html_text, line_dedup, lm_scoring, mixing, packing, quality_classifier, quality_rules, sharding, simhash

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": corpus_pipeline.run,
}

SQL = {"op1_line_dedup": line_dedup.OP1_SQL, "op4_exact_dedup": exact_dedup.OP4_SQL, "op7_quality_rules": quality_rules.OP7_SQL}
