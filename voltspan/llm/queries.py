"""The operators' queries over whole tables and, where SQL can express them, their SQL."""

from __future__ import annotations

from voltspan.llm import audit, chat, decontaminate, quality, substrings
from voltspan.llm.alignment import op12_align_tokenizers
from voltspan.llm.audit import op13_filter_audit
from voltspan.llm.chat import op2_chat_format
from voltspan.llm.codes import op11_addressable_codes
from voltspan.llm.decontaminate import op7_decontaminate
from voltspan.llm.language import op3_language
from voltspan.llm.packing import op8_packing
from voltspan.llm.quality import op1_quality
from voltspan.llm.secrets import op4_secrets
from voltspan.llm.sharding import op9_virtual_slots
from voltspan.llm.simhash import op10_simhash
from voltspan.llm.substrings import op6_substrings
from voltspan.llm.urls import op5_url_filter

QUERIES = {
    "op1_quality": op1_quality,
    "op2_chat_format": op2_chat_format,
    "op3_language": op3_language,
    "op4_secrets": op4_secrets,
    "op5_url_filter": op5_url_filter,
    "op6_substrings": op6_substrings,
    "op7_decontaminate": op7_decontaminate,
    "op8_packing": op8_packing,
    "op9_virtual_slots": op9_virtual_slots,
    "op10_simhash": op10_simhash,
    "op11_addressable_codes": op11_addressable_codes,
    "op12_align_tokenizers": op12_align_tokenizers,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op1_quality": quality.oracle_sql(),
    "op2_chat_format": chat.ORACLE_SQL,
    "op6_substrings": substrings.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op13_filter_audit": audit.ORACLE_SQL,
}
