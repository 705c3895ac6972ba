"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from .byte_bpe import op7_byte_bpe
from .conversation_repair import SQL_OP11, op11_conversation_repair
from .decontaminate import SQL_OP1, op1_decontaminate
from .exact_dedup import SQL_OP12, op12_exact_dedup
from .fingerprints import op4_fingerprints
from .language import op5_language
from .language_model import op2_language_model
from .near_dedup import SQL_OP9, op9_near_dedup
from .quality import op8_quality
from .ranked_search import SQL_OP13, op13_ranked_search
from .repeated_phrases import SQL_OP6, op6_repeated_phrases
from .token_counts import op3_token_counts
from .url_filter import SQL_OP10, op10_url_filter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_model": op2_language_model,
    "op3_token_counts": op3_token_counts,
    "op4_fingerprints": op4_fingerprints,
    "op5_language": op5_language,
    "op6_repeated_phrases": op6_repeated_phrases,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES = {
    "op1_decontaminate": SQL_OP1, "op6_repeated_phrases": SQL_OP6, "op9_near_dedup": SQL_OP9, "op10_url_filter": SQL_OP10,
    "op11_conversation_repair": SQL_OP11, "op12_exact_dedup": SQL_OP12, "op13_ranked_search": SQL_OP13,
}
