"""The corpus operators' queries and their SQL twins, by name."""

from __future__ import annotations

from . import centroids, exact_dedup, language_id, licenses, packing, pii, quality, resampling, sentencepiece_dropout, sharding, simhash, substring_dedup, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_licenses": licenses.op3_licenses,
    "op4_simhash": simhash.op4_simhash,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_sentencepiece": sentencepiece_dropout.op6_sentencepiece,
    "op7_packing": packing.op7_packing,
    "op8_language_id": language_id.op8_language_id,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality.op10_quality,
    "op11_resampling": resampling.op11_resampling,
    "op12_centroids": centroids.op12_centroids,
    "op13_warc": warc.op13_warc,
}

ORACLES = {
    "op1_sharding": sharding.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_licenses": licenses.SQL,
    "op11_resampling": resampling.SQL,
    "op12_centroids": centroids.SQL,
    "op13_warc": warc.SQL,
}
