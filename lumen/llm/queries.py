"""Registered queries of the operators and their DuckDB oracles."""

from __future__ import annotations

from lumen.llm import op3_mixing, op8_topk, op12_embeddings
from lumen.llm.op1_sharding import op1_sharding
from lumen.llm.op10_secrets import op10_secrets
from lumen.llm.op11_conversations import op11_conversations
from lumen.llm.op13_spelling import op13_spelling
from lumen.llm.op2_quality import op2_quality
from lumen.llm.op4_lm import op4_lm_score
from lumen.llm.op5_decontamination import op5_decontamination
from lumen.llm.op6_tokens import op6_tokens
from lumen.llm.op7_language import op7_language_id
from lumen.llm.op9_neardup import op9_neardup

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing.op3_mixing,
    "op4_lm_score": op4_lm_score,
    "op5_decontamination": op5_decontamination,
    "op6_tokens": op6_tokens,
    "op7_language_id": op7_language_id,
    "op8_topk": op8_topk.op8_topk,
    "op9_neardup": op9_neardup,
    "op10_secrets": op10_secrets,
    "op11_conversations": op11_conversations,
    "op12_embeddings": op12_embeddings.op12_embeddings,
    "op13_spelling": op13_spelling,
}

ORACLE: dict[str, str] = {"op3_mixing": op3_mixing.ORACLE_SQL, "op8_topk": op8_topk.ORACLE_SQL,
                          "op11_conversations": op11_conversations,
    "op12_embeddings": op12_embeddings.ORACLE_SQL}
