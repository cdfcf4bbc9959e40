"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from keystrata.llm import bpe, exact_dedup, license_scan, line_dedup, lm_scoring, mixing, ngram_jaccard, quality_classifier, quality_rules, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_mixing": mixing.op6_mixing,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_bpe": bpe.op8_bpe,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_ngram_jaccard": ngram_jaccard.op10_ngram_jaccard,
    "pipeline": corpus_pipeline.run,
}
SQL = {**substring_dedup.SQL, **line_dedup.SQL, **mixing.SQL, **exact_dedup.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
