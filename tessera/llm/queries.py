"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, dedup, jaccard, langid, packing, repeats, secrets, spotsigs, store, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_exact_dedup": dedup.op5_exact_dedup,
    "op2_document_fingerprints": spotsigs.op2_document_fingerprints,
    "op3_token_store": store.op3_token_store,
    "op6_language_id": langid.op6_language_id,
    "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
    "op8_suffix_dedup": repeats.op8_suffix_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_secret_scans": secrets.op10_secret_scans,
}
ORACLES = {
    "op4_ngram_jaccard": jaccard.ORACLE,
    "op5_exact_dedup": dedup.ORACLE,
}
