"""The corpus operators' queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from stareflow.llm.bpe import op3_byte_bpe
from stareflow.llm.chat import OP10_SQL, op10_chat_formatting
from stareflow.llm.conversation_repair import op13_conversation_repair
from stareflow.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from stareflow.llm.lm_scoring import op5_lm_scoring
from stareflow.llm.mixing import op4_mix_sources
from stareflow.llm.ngram_join import op6_ngram_jaccard_join
from stareflow.llm.packing import op7_packed_ids
from stareflow.llm.quality import op8_quality_rules
from stareflow.llm.secrets import op1_secret_scan
from stareflow.llm.suffix_dedup import op11_suffix_dedup
from stareflow.llm.token_counts import op2_token_counts
from stareflow.llm.topk import OP9_SQL, op9_exact_top_k

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mix_sources": op4_mix_sources,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_packed_ids": op7_packed_ids,
    "op8_quality_rules": op8_quality_rules,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

#: The others have no SQL: their methods are iterative, trained, or over ids that SQL can't make.
#: tests/llm holds them against brute force.
ORACLE_SQL = {
    "op9_exact_top_k": OP9_SQL,
    "op10_chat_formatting": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
}
