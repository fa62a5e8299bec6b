"""The registered queries of this subpackage and their oracles."""

from __future__ import annotations

from cadenza.llm import chat, decontam, exact, fingerprints, html_text, infill, mixing, near, packing, private, quality, url_filter, whitening

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_url_filter": url_filter.query,
    "op3_minhash_near_dedup": near.query,
    "op4_html_extraction": html_text.query,
    "op5_exact_dedup": exact.query,
    "op6_pii_spans": private.query,
    "op7_best_fit_packing": packing.query,
    "op8_quality_classifier": quality.query,
    "op9_document_fingerprints": fingerprints.query,
    "op10_preference_format": chat.query,
    "op11_fill_in_middle": infill.query,
    "op12_decontamination": decontam.query,
    "op13_embedding_whitening": whitening.query,
}
#: DuckDB SQL where SQL can express the operator.
ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op2_url_filter": url_filter.SQL,
    "op5_exact_dedup": exact.SQL,
    "op10_preference_format": chat.SQL,
    "op11_fill_in_middle": infill.SQL,
    "op12_decontamination": decontam.SQL,
}
