"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from skein.llm import bpe, context_tree, exact_dedup, html_text, matroska, merkle, packing, pii, quality, simhash, token_counts, toxicity, vector_codes

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_html_text": html_text.op3_html_text,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_simhash": simhash.op7_simhash,
    "op8_packing": packing.op8_packing,
    "op9_matroska": matroska.op9_matroska,
    "op10_pii": pii.op10_pii,
    "op11_merkle": merkle.op11_merkle,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_context_tree": context_tree.op13_context_tree,
}

ORACLES = {"op5_exact_dedup": exact_dedup.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL}
