"""The queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from tessera.llm.bpe import op2_bpe
from tessera.llm.cap_filters import OP5_SQL, op5_cap_filters
from tessera.llm.chat_format import OP4_SQL, op4_chat_format
from tessera.llm.divergence import OP13_SQL, op13_divergence
from tessera.llm.fingerprints import op6_fingerprints
from tessera.llm.html_text import op8_html
from tessera.llm.importance import OP12_SQL, op12_importance
from tessera.llm.line_dedup import OP3_SQL, op3_line_dedup
from tessera.llm.mixing import op7_mixing
from tessera.llm.ngram_join import OP10_SQL, op10_ngram_join
from tessera.llm.substring_dedup import OP11_SQL, op11_substring_dedup
from tessera.llm.toxicity import op1_toxicity
from tessera.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_cap_filters": op5_cap_filters,
    "op6_fingerprints": op6_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_html": op8_html,
    "op9_url_filter": op9_url_filter,
    "op10_ngram_join": op10_ngram_join,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_importance": op12_importance,
    "op13_divergence": op13_divergence,
}
ORACLES = {"op3_line_dedup": OP3_SQL, "op4_chat_format": OP4_SQL, "op5_cap_filters": OP5_SQL, "op9_url_filter": OP9_SQL, "op10_ngram_join": OP10_SQL, "op11_substring_dedup": OP11_SQL, "op12_importance": OP12_SQL, "op13_divergence": OP13_SQL}
