"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprints, langid, licenses, lines, mixing, nearsets, secrets, toxicity, urls

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_near_dedup": nearsets.op3_near_dedup,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_licenses": licenses.op5_licenses,
    "op6_language_id": langid.op6_language_id,
    "op7_secrets": secrets.op7_secrets,
    "op8_url_filter": urls.op8_url_filter,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_fingerprint": fingerprints.op10_fingerprint,
}

SQL = {
    "op3_near_dedup": nearsets.SQL,
    "op5_licenses": licenses.SQL,
    "op7_secrets": secrets.SQL,
    "op9_decontaminate": decontaminate.SQL,
}
