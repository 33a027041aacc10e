"""The queries of this subpackage on the driver's tables, and the SQL for those that SQL can state."""

from __future__ import annotations

from . import ann_codes, exact_topk, hilbert_shards, language_id, lexicon_bpe, line_templates, near_dedup, packing, token_attribution, url_filter

QUERIES = {
    "op1_token_attribution": token_attribution.op1,
    "op2_url_filter": url_filter.op2,
    "op3_packing": packing.op3,
    "op4_exact_topk": exact_topk.op4,
    "op5_near_dedup": near_dedup.op5,
    "op6_ann_codes": ann_codes.op6,
    "op7_hilbert_shards": hilbert_shards.op7,
    "op8_lexicon_bpe": lexicon_bpe.op8,
    "op9_language_id": language_id.op9,
    "op10_line_templates": line_templates.op10,
}

SQL = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op4_exact_topk": exact_topk.OP4_SQL,
    "op10_line_templates": line_templates.OP10_SQL,
}
