"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import ann_forest, bottomk, crf, debruijn, mixing, packing, rans, simhash_anchor, url_gbt, wrapper

QUERIES = {
    "op1_ann_forest": ann_forest.op1_ann_forest,
    "op2_url_gbt": url_gbt.op2_url_gbt,
    "op3_wrapper": wrapper.op3_wrapper,
    "op4_pattern_pack": packing.op4_pattern_pack,
    "op5_rans": rans.op5_rans,
    "op6_bottomk": bottomk.op6_bottomk,
    "op7_simhash_anchor": simhash_anchor.op7_simhash_anchor,
    "op8_debruijn_dedup": debruijn.op8_debruijn_dedup,
    "op9_crf_quality": crf.op9_crf_quality,
    "op10_weighted_mix": mixing.op10_weighted_mix,
}
ORACLES: dict[str, str] = {"op8_debruijn_dedup": debruijn.OP8_SQL, "op10_weighted_mix": mixing.OP10_SQL}
