"""Queries and expected SQL of this package."""

from __future__ import annotations

from pageloom.llm import (
    bitpack, crf, hilbert, mcd, mixing, negatives, neighbours, packing, prefix_hash, simhash, templates,
    toxicity, whitening,
)

QUERIES = {
    "op7_soft_membership_mixing": mixing.query,
    "op10_template_line_dedup": templates.query,
    "op6_hilbert_shards": hilbert.query,
    "op2_mcd_outliers": mcd.query,
    "op1_crf_language_id": crf.query,
    "op4_convolutional_toxicity": toxicity.query,
    "op3_prefix_hashes": prefix_hash.query,
    "op5_cutting_stock_packing": packing.query,
    "op9_fixed_width_bit_packing": bitpack.query,
    "op8_simhash_near_dedup": simhash.query,
    "op11_segment_summary_negatives": negatives.query,
    "op12_adaptive_dimension_scan": neighbours.query,
    "op13_block_matrix_whitening": whitening.query,
}

ORACLES: dict[str, str] = {
    "op6_hilbert_shards": hilbert.oracle(),
    "op10_template_line_dedup": templates.oracle(),
    "op11_segment_summary_negatives": negatives.oracle(),
}
