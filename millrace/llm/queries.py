"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from millrace.llm import chat_format, filter_audit, fingerprints, jaccard_join, mixing, perplexity, phrases, piece_codec, pii, quality_rules, substring_dedup
from millrace.llm.language_id import op2_language_id
from millrace.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_perplexity": perplexity.op1_perplexity,
    "op2_language_id": op2_language_id,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_piece_codec": piece_codec.op4_piece_codec,
    "op5_mixing": mixing.op5_mixing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_personal_data": pii.op11_personal_data,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_phrases": phrases.op13_phrases,
}
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat_format.ORACLE_SQL,
    "op5_mixing": mixing.ORACLE_SQL,
    "op7_jaccard_join": jaccard_join.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
