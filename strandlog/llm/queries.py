"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from strandlog.llm import byte_bpe, decontaminate, langid, pii, quality, simhash, suffix_dedup, token_store, topk, url_filter

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_store": token_store.op3_token_store,
    "op4_pii": pii.op4_pii,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_quality": quality.op6_quality,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_topk": topk.op9_topk,
}
ORACLE_SQL = {
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op4_pii": pii.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_topk": topk.ORACLE,
}
