"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from psephos.llm import chat, codebooks, divergence, embeddings, langid, lm, mixing, packing, quality, secrets, simhash, tokens, url_filter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_embedding_near_dedup": embeddings.op5_embedding_near_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_token_output": tokens.op7_token_output,
    "op8_lm_score": lm.op8_lm_score,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_vector_codes": codebooks.op11_vector_codes,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_chat_format": chat.op13_chat_format,
}
SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op5_embedding_near_dedup": embeddings.OP5_SQL,
    "op11_vector_codes": codebooks.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_chat_format": chat.OP13_SQL,
}
