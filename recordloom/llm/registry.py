"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, host_rules, html_cut, langid, licenses, line_dedup, media, mixing, near_dup, toxicity

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_bpe_encode_decode": bpe.op3_bpe_encode_decode,
    "op4_minhash_near_dedup": near_dup.op4_minhash_near_dedup,
    "op5_language_id": langid.op5_language_id,
    "op6_license_notices": licenses.op6_license_notices,
    "op7_host_quality": host_rules.op7_host_quality,
    "page_host_quality": host_rules.page_host_quality,
    "op8_html_extraction": html_cut.op8_html_extraction,
    "op9_media_columns": media.op9_media_columns,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLE_SQL: dict[str, str] = {"op7_host_quality": host_rules.ORACLE_SQL, "page_host_quality": host_rules.PAGES_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL}
