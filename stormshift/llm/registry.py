"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from stormshift.llm import chat_format, exact_dedup, merkle, near_dedup, spelling
from stormshift.llm.chat_format import op1_chat_format
from stormshift.llm.exact_dedup import op12_exact_dedup
from stormshift.llm.language_id import op8_language_id
from stormshift.llm.lm_scoring import op9_lm_scoring
from stormshift.llm.media_sequences import op3_media_sequences
from stormshift.llm.merkle import op11_merkle_manifest
from stormshift.llm.mixing import op6_mixing
from stormshift.llm.near_dedup import op7_near_dedup
from stormshift.llm.packing import op4_packing
from stormshift.llm.spelling import op13_spelling_variants
from stormshift.llm.token_counts import op5_token_counts
from stormshift.llm.token_files import op2_token_files
from stormshift.llm.vector_search import op10_vector_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_token_files, op3_media_sequences, op4_packing, op5_token_counts,
        op6_mixing, op7_near_dedup, op8_language_id, op9_lm_scoring, op10_vector_search,
        op11_merkle_manifest, op12_exact_dedup, op13_spelling_variants,
    )
}
ORACLE_SQL = {
    "op1_chat_format": chat_format.ORACLE, "op7_near_dedup": near_dedup.ORACLE, "op11_merkle_manifest": merkle.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE, "op13_spelling_variants": spelling.ORACLE,
}
