"""The operators' registered queries and their SQL twins."""

from __future__ import annotations

from weftwork.llm import chat, hamming, langid, packing, pii, quality, sentence, simhash, substring, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_warc": warc.op2_warc,
    "op3_pii": pii.op3_pii,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_language_id": langid.op6_language_id,
    "op7_top_k_search": hamming.op7_top_k_search,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_sentencepiece": sentence.op10_sentencepiece,
}

ORACLE = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op7_top_k_search": hamming.OP7_SQL,
}
