"""Queries of the training-data operators, by name."""

from __future__ import annotations

import corpus_pipeline

from . import fingerprints, language_id, line_dedup, packing, pii, segmentation, sharding, simhash, toxicity, vector_search


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_pii": pii.op3_pii,
        "op4_language_id": language_id.op4_language_id,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_sharding": sharding.op6_sharding,
        "op7_nearest_neighbours": vector_search.op7_nearest_neighbours,
        "op8_packing": packing.op8_packing,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "pipeline": corpus_pipeline.run,
        "op10_segmentation": segmentation.op10_segmentation,
    }


def oracle_sql() -> dict[str, str]:
    """None of these can be written in the oracle's SQL; tests hold them against brute force."""
    return {}
