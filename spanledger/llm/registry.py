"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import hard_negatives, language, licences, merkle, mixing, pieces, prefix_forest, sharding, simhash, substrings, toxicity, vector_dedup, warc


def queries() -> dict:
    return {
        "op1_warc_bundles": warc.op1_warc_bundles,
        "op2_feistel_shards": sharding.op2_feistel_shards,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_toxicity_lexicon": toxicity.op4_toxicity_lexicon,
        "op5_licence_scan": licences.op5_licence_scan,
        "op6_hierarchical_mix": mixing.op6_hierarchical_mix,
        "op7_vector_components": vector_dedup.op7_vector_components,
        "op8_simhash_components": simhash.op8_simhash_components,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_prefix_forest": prefix_forest.op10_prefix_forest,
        "op11_language_kernels": language.op11_language_kernels,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict:
    return {"op1_warc_bundles": warc.OP1_SQL, "op6_hierarchical_mix": mixing.OP6_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
