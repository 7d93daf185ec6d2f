"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from . import chat_format, exact_dedup, host_rules, language_id, mixing, near_dedup, packing, quality_crf, substring_dedup, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality_crf.op7_quality,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_language_id": language_id.op9_language_id,
    "op10_host_rules": host_rules.op10_host_rules,
}

ORACLE = {**exact_dedup.ORACLE, **mixing.ORACLE, **near_dedup.ORACLE, **chat_format.ORACLE, **host_rules.ORACLE}
