"""The registered queries over the training-data tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from cadenza.llm import chat_format, decontaminate, embedding_dedup, filter_audit, quality_rules, source_audit, url_filter
from cadenza.llm.chat_format import op6_chat_format
from cadenza.llm.decontaminate import op7_decontaminate
from cadenza.llm.embedding_dedup import op12_embedding_dedup
from cadenza.llm.filter_audit import op13_filter_audit
from cadenza.llm.near_dedup import op10_minhash_dedup
from cadenza.llm.quality_classifier import op2_quality_classifier
from cadenza.llm.quality_rules import op1_quality_rules
from cadenza.llm.sentencepiece import op9_sentencepiece
from cadenza.llm.source_audit import op11_source_audit
from cadenza.llm.substring_dedup import op3_substring_dedup
from cadenza.llm.token_counts import op4_token_counts
from cadenza.llm.toxicity import op8_toxicity
from cadenza.llm.url_filter import op5_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_quality_classifier,
        op3_substring_dedup,
        op4_token_counts,
        op5_url_filter,
        op6_chat_format,
        op7_decontaminate,
        op8_toxicity,
        op9_sentencepiece,
        op10_minhash_dedup,
        op11_source_audit,
        op12_embedding_dedup,
        op13_filter_audit,
    )
}
SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_chat_format": chat_format.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op11_source_audit": source_audit.SQL,
    "op12_embedding_dedup": embedding_dedup.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
