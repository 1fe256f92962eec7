"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact_dedup, fingerprints, jaccard_join, merkle, mixing, negatives, ngram_lm, packing, quality, sstable, substrings, toxicity, warc

QUERIES = {
    "op1_hilbert_packing": packing.op1_hilbert_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sstable_shards": sstable.op3_sstable_shards,
    "op4_ngram_lm": ngram_lm.op4_ngram_lm,
    "op5_curriculum_mix": mixing.op5_curriculum_mix,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_warc_derivatives": warc.op7_warc_derivatives,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_substring_dedup": substrings.op12_substring_dedup,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

SQL = {
    "op5_curriculum_mix": mixing.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op12_substring_dedup": substrings.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
