"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tarmac.llm import bpe, chat, fagin, jaccard, lm, packing, quality, rpforest, secrets, simplex, topk, toxicity, urls

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_embedding_near_dedup": rpforest.op5_embedding_near_dedup,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_bpe": bpe.op7_bpe,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op11_url_filters": urls.op11_url_filters,
    "op12_hard_negative_mining": fagin.op12_hard_negative_mining,
    "op13_centroid_clustering": simplex.op13_centroid_clustering,
    "chat_mixed_layouts": chat.chat_mixed_layouts,
}
ORACLES = {
    "op2_secret_scans": secrets.OP2_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op6_exact_top_k": topk.OP6_SQL,
    "op11_url_filters": urls.OP11_SQL,
    "op12_hard_negative_mining": fagin.OP12_SQL,
    "op13_centroid_clustering": simplex.OP13_SQL,
    "chat_mixed_layouts": chat.MIXED_SQL,
}
