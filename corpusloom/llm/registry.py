"""The queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from corpusloom.llm.decontaminate import OP10_SQL, op10_decontaminate
from corpusloom.llm.mixing import OP8_SQL, op8_mixing
from corpusloom.llm.pii import op9_pii
from corpusloom.llm.quality import op4_quality
from corpusloom.llm.secrets import op7_secrets
from corpusloom.llm.simhash import op1_simhash
from corpusloom.llm.suffix_tree import op5_suffix_tree
from corpusloom.llm.tokens import op2_tokens
from corpusloom.llm.topk import OP6_SQL, op6_topk
from corpusloom.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_tokens": op2_tokens,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_topk": op6_topk,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES = {"op6_topk": OP6_SQL, "op8_mixing": OP8_SQL, "op10_decontaminate": OP10_SQL}
