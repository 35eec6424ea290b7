"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from quillspark.llm.bpe import op8_bpe
from quillspark.llm.chat_format import OP1_SQL, op1_chat_format
from quillspark.llm.decontaminate import OP5_SQL, op5_decontaminate
from quillspark.llm.filter_audit import OP11_SQL, op11_filter_audit
from quillspark.llm.language_id import op10_language_id
from quillspark.llm.near_dedup import op9_near_dedup
from quillspark.llm.periodic_runs import op13_periodic_runs
from quillspark.llm.pii import op2_pii
from quillspark.llm.quality_classifier import op4_quality_classifier
from quillspark.llm.quality_rules import OP3_SQL, op3_quality_rules
from quillspark.llm.sentence_pieces import op12_sentencepiece
from quillspark.llm.toxicity import op6_toxicity
from quillspark.llm.url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_bpe": op8_bpe,
    "op9_near_dedup": op9_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {
    "op1_chat_format": OP1_SQL, "op3_quality_rules": OP3_SQL, "op5_decontaminate": OP5_SQL, "op7_url_filter": OP7_SQL, "op11_filter_audit": OP11_SQL,
}
