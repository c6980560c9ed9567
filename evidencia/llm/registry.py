"""The registered corpus queries: one per operator, applied to its whole table."""

from __future__ import annotations

from evidencia.llm import (
    alignment, decontaminate, langid, licenses, packing, periodic, quality, sharding, similar, token_counts, token_files, toxicity,
    urls,
)

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_extendible_shards": sharding.query,
    "op3_language_id": langid.query,
    "op4_pack_sequences": packing.query,
    "op5_url_rules": urls.query,
    "op6_quality_rules": quality.query,
    "op7_decontaminate": decontaminate.query,
    "op8_token_counts": token_counts.query,
    "op9_toxicity": toxicity.query,
    "op10_jaccard_join": similar.query,
    "op11_periodic_runs": periodic.query,
    "op12_token_alignment": alignment.query,
    "op13_token_files": token_files.query,
}

ORACLES = {
    "op2_extendible_shards": sharding.ORACLE_SQL,
    "op5_url_rules": urls.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op10_jaccard_join": similar.ORACLE_SQL,
}
