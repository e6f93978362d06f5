"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import langid, license_scan, mixing, mtree, oracles, pieces, ppm, quality, simhash, suffix_dedup, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_langid": langid.op4_langid,
    "op5_pieces": pieces.op5_pieces,
    "op6_lm_score": ppm.op6_lm_score,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_topk": mtree.op10_topk,
}

ORACLES = {
    "op1_license_scan": oracles.license_scan_sql(),
    "op2_suffix_dedup": oracles.suffix_dedup_sql(),
    "op7_mixing": mixing.ORACLE_SQL,
    "op8_quality": oracles.quality_sql(),
    "op10_topk": mtree.ORACLE_SQL,
}
