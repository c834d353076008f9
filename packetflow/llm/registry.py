"""The queries of this package and their SQL."""

from __future__ import annotations

from packetflow.llm import backoff_lm, collocations, decontaminate, lexicon_bpe, main_text, mixing, near_dedup, quality_rules, ranking, secrets, token_files, tool_calls, vector_codes

QUERIES = {
    "op4_token_files": token_files.op4_token_files,
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op10_backoff_lm": backoff_lm.op10_backoff_lm,
    "op2_tool_call_linking": tool_calls.op2_tool_call_linking,
    "op6_html_main_text": main_text.op6_html_main_text,
    "op3_quality_classifier": ranking.op3_quality_classifier,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op11_lexicon_bpe": lexicon_bpe.op11_lexicon_bpe,
    "op12_collocations": collocations.op12_collocations,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE = {
    "op2_tool_call_linking": tool_calls.ORACLE_SQL,
    "op5_source_mixing": mixing.ORACLE_SQL,
    "op7_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
