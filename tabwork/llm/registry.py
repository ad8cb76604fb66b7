"""Queries of the training-data operators and the SQL of those that SQL can express."""
from __future__ import annotations

from . import alignment, centroids, decontam, langid, mixing, neardup, packing, preference, sharding, simhash, sitetree, toxicity, warc


def llm_queries():
    return {
        "op1_context_mixing": mixing.op1_context_mixing,
        "op2_power_packing": packing.op2_power_packing,
        "op3_suffix_decontamination": decontam.op3_suffix_decontamination,
        "op4_warc_writer": warc.op4_warc_writer,
        "op5_spherical_cells": neardup.op5_spherical_cells,
        "op6_simhash_dedup": simhash.op6_simhash_dedup,
        "op7_site_style_tree": sitetree.op7_site_style_tree,
        "op8_jump_sharding": sharding.op8_jump_sharding,
        "op9_counterfactual_toxicity": toxicity.op9_counterfactual_toxicity,
        "op10_mixture_langid": langid.op10_mixture_langid,
        "op11_pairwise_quality": preference.op11_pairwise_quality,
        "op12_token_alignment": alignment.op12_token_alignment,
        "op13_integer_centroids": centroids.op13_integer_centroids,
    }


def llm_oracles():
    return {
        "op3_suffix_decontamination": decontam.OP3_SQL,
        "op4_warc_writer": warc.OP4_SQL,
        "op5_spherical_cells": neardup.OP5_SQL,
        "op13_integer_centroids": centroids.OP13_SQL,
    }
