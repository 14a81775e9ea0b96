"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from themeloom.llm import bpe, decontaminate, html, jaccard, language, packing, quality, repair, sharding, suffixes, topk, trie, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_quality": quality.op2_quality,
    "op3_language": language.op3_language,
    "op4_top_k": topk.op4_top_k,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_warc": warc.op6_warc,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_sharding": sharding.op8_sharding,
    "op10_html": html.op10_html,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_best_fit": packing.op13_best_fit,
}

SQL: dict[str, str] = {
    "op1_jaccard_join": jaccard.OP1_SQL,
    "op4_top_k": topk.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op11_structure_repair": repair.OP11_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
}
