"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP6_SQL, op6_chat_format
from .chunks import op3_substring_dedup
from .leaks import op7_decontamination
from .licences import op10_licences
from .lines import OP4_SQL, op4_line_dedup
from .near import op5_near_duplicates
from .pieces import op1_sentencepiece
from .quality import op9_quality
from .repair import OP13_SQL, op13_conversation_repair
from .rollup import op8_token_counts
from .rules import OP12_SQL, op12_quality_rules
from .syncmers import op2_syncmers
from .vectors import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_syncmers": op2_syncmers,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_chat_format": op6_chat_format,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_licences": op10_licences,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_repair": op13_conversation_repair,
}
SQL = {"op4_line_dedup": OP4_SQL, "op6_chat_format": OP6_SQL, "op11_vector_codes": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_conversation_repair": OP13_SQL}
