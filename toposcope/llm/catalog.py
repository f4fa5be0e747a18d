"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from toposcope.llm import (
    bloom_lm,
    byte_cnn,
    circulant_minhash,
    decontaminate,
    deobfuscate,
    external_shuffle,
    max_tree_search,
    permutation_index,
    secret_ledger,
    site_style_tree,
    soft_mixing,
    source_divergence,
    token_rollups,
)


def queries() -> dict:
    return {
        "op1_bloom_lm": bloom_lm.op1_bloom_lm,
        "op2_circulant_minhash": circulant_minhash.op2_circulant_minhash,
        "op3_byte_cnn": byte_cnn.op3_byte_cnn,
        "op4_soft_mixing": soft_mixing.op4_soft_mixing,
        "op5_token_rollups": token_rollups.op5_token_rollups,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_site_style_tree": site_style_tree.op7_site_style_tree,
        "op8_secret_ledger": secret_ledger.op8_secret_ledger,
        "op9_deobfuscate": deobfuscate.op9_deobfuscate,
        "op10_permutation_index": permutation_index.op10_permutation_index,
        "op11_source_divergence": source_divergence.op11_source_divergence,
        "op12_external_shuffle": external_shuffle.op12_external_shuffle,
        "op13_max_tree_search": max_tree_search.op13_max_tree_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op6_decontaminate": decontaminate.ORACLE_SQL,
        "op8_secret_ledger": secret_ledger.ORACLE_SQL,
        "op11_source_divergence": source_divergence.ORACLE_SQL,
        "op13_max_tree_search": max_tree_search.ORACLE_SQL,
    }
