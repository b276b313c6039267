"""The training-data queries: name to (query, SQL or None)."""

from __future__ import annotations

from veilstat.llm import alignment, bpe, html_extract, lang_id, media_columns, ngram_join, packing, pii, resampling, sharding, topk, toxicity, url_filter

QUERIES = {
    "op9_ngram_join": (ngram_join.query, ngram_join.ORACLE_SQL),
    "op1_html_extract": (html_extract.query, None),
    "op4_packing": (packing.query, None),
    "op5_topk": (topk.query, topk.ORACLE_SQL),
    "op6_pii": (pii.query, None),
    "op2_bpe": (bpe.query, None),
    "op3_toxicity": (toxicity.query, None),
    "op7_lang_id": (lang_id.query, None),
    "op8_url_filter": (url_filter.query, url_filter.ORACLE_SQL),
    "op10_media_columns": (media_columns.query, None),
    "op11_alignment": (alignment.query, None),
    "op12_sharding": (sharding.query, sharding.ORACLE_SQL),
    "op13_resampling": (resampling.query, resampling.ORACLE_SQL),
}
