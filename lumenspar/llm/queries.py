"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from lumenspar.llm import decontaminate, line_dedup, lm_score, near_dedup, pack, quality_classifier, quality_rules, substring_dedup, url_filter, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op4_lm_score": lm_score.op4_lm_score,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op5_pack": pack.op5_pack,
    "op6_warc": warc.op6_warc,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE = {
    "op4_lm_score": lm_score.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op2_near_dedup": near_dedup.SQL,
    "op6_warc": warc.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op10_quality_rules": quality_rules.SQL,
}
