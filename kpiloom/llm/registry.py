"""One query for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from kpiloom.llm import ann, fingerprints, langid, licenses, linededup, lm, minhash, mixing, packing, secrets

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "op2_language_id": langid.query,
    "op3_lm_score": lm.query,
    "op4_nearest": ann.query,
    "op5_source_mix": mixing.query,
    "op6_line_dedup": linededup.query,
    "op7_near_duplicates": minhash.query,
    "op8_best_fit_packing": packing.query,
    "op9_license_scan": licenses.query,
    "op10_secret_scan": secrets.query,
}

ORACLES: dict[str, str] = {
    "op5_source_mix": mixing.ORACLE,
    "op7_near_duplicates": minhash.ORACLE,
}
