"""The queries of this folder's operators, by the names the driver uses, and their SQL."""

from __future__ import annotations

from postlake.llm import op01_quality, op02_tokens, op03_crf, op04_bpe, op05_substrings, op06_near, op07_secrets, op08_decontaminate, op09_chat, op10_html, op11_warc, op12_importance, op13_alignment

QUERIES = {
    "op1_quality_rules": op01_quality.query,
    "op2_token_counts": op02_tokens.query,
    "op3_quality_classifier": op03_crf.query,
    "op4_bpe": op04_bpe.query,
    "op5_substring_dedup": op05_substrings.query,
    "op6_near_duplicates": op06_near.query,
    "op7_secrets": op07_secrets.query,
    "op8_decontamination": op08_decontaminate.query,
    "op9_chat_formatting": op09_chat.query,
    "op10_html_extraction": op10_html.query,
    "op11_warc": op11_warc.query,
    "op12_importance_resampling": op12_importance.query,
    "op13_tokenizer_alignment": op13_alignment.query,
}

ORACLE_SQL = {
    "op1_quality_rules": op01_quality.SQL,
    "op7_secrets": op07_secrets.SQL,
    "op8_decontamination": op08_decontaminate.SQL,
    "op9_chat_formatting": op09_chat.SQL,
    "op11_warc": op11_warc.SQL,
    "op12_importance_resampling": op12_importance.SQL,
}
