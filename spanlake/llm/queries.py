"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audit, collocations, decontaminate, flac, language, mixing, neardup, pseudonyms, quality, repeats, sharding, topk, toxicity

QUERIES = {
    "op1_language": language.query,
    "op2_pseudonyms": pseudonyms.query,
    "op3_mix_sources": mixing.query,
    "op4_quality": quality.query,
    "op5_toxicity": toxicity.query,
    "op6_shard_tree": sharding.query,
    "op7_decontaminate": decontaminate.query,
    "op8_flac": flac.query,
    "op9_repeats": repeats.query,
    "op10_near_duplicates": neardup.query,
    "op11_collocations": collocations.query,
    "op12_topk": topk.query,
    "op13_filter_audit": audit.query,
}
SQL = {
    "op3_mix_sources": mixing.SQL,
    "op6_shard_tree": sharding.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op9_repeats": repeats.SQL,
    "op10_near_duplicates": neardup.SQL,
    "op11_collocations": collocations.SQL,
    "op12_topk": topk.SQL,
    "op13_filter_audit": audit.SQL,
}
