"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, embedding_dedup, jaccard_join, lexical, lm_score, mixing, neighbours, quality, secrets, token_rollups, warc, whitening

QUERIES = {
    "op1_lm_scoring": lm_score.op1_lm_scoring,
    "op2_mixing_sources": mixing.op2_mixing_sources,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_embedding_near_dedup": embedding_dedup.op4_embedding_near_dedup,
    "op5_token_counts": token_rollups.op5_token_counts,
    "op6_warc": warc.op6_warc,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_nearest_neighbours": neighbours.op12_nearest_neighbours,
    "op13_ranked_lexical_search": lexical.op13_ranked_lexical_search,
}

ORACLES = {
    "op4_embedding_near_dedup": embedding_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op10_ngram_jaccard_join": jaccard_join.ORACLE,
    "op13_ranked_lexical_search": lexical.ORACLE,
}
