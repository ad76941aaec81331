"""Queries and SQL of the subpackage, by name."""

from __future__ import annotations

from . import bpe, chat, ctw, decontaminate, jaccard, media, packing, passages, secrets, toxicity, vectorcodes, whitening, wordpiece

QUERIES = {
    f.__name__: f
    for f in (
        passages.op1_substring_dedup,
        secrets.op2_secret_scans,
        toxicity.op3_toxicity,
        jaccard.op4_ngram_jaccard_join,
        decontaminate.op5_benchmark_decontamination,
        wordpiece.op6_token_counts,
        chat.op7_chat_formatting,
        media.op8_media_columns,
        packing.op9_best_fit_packing,
        ctw.op10_lm_scoring,
        vectorcodes.op11_vector_codes,
        bpe.op12_byte_bpe,
        whitening.op13_embedding_whitening,
    )
}
ORACLE: dict[str, str] = {"op2_secret_scans": secrets.ORACLE, "op7_chat_formatting": chat.ORACLE, "op11_vector_codes": vectorcodes.ORACLE}
