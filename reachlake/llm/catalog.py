"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from reachlake.llm import bpe, embedding_dedup, fingerprints, hard_negatives, language_id, line_dedup, minhash_dedup, packing, pitman_yor, quality_rules, spelling_variants, toxicity, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_pitman_yor_lm": pitman_yor.query,
    "op3_weighted_fingerprints": fingerprints.query,
    "op4_language_id": language_id.query,
    "op5_line_dedup": line_dedup.query,
    "op6_embedding_near_dedup": embedding_dedup.query,
    "op7_bpe_round_trip": bpe.query,
    "op8_url_filters": url_filter.query,
    "op9_toxicity": toxicity.query,
    "op10_minhash_near_dedup": minhash_dedup.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_quality_rules": quality_rules.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op8_url_filters": url_filter.SQL,
    "op11_spelling_variants": spelling_variants.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_quality_rules": quality_rules.SQL,
}
