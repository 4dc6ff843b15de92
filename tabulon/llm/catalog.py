"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tabulon.llm import centroids, chunk_store, decontamination, licenses, packing, pieces, pii, quality_classifier, quality_rules, repeats, simhash, spelling, toxicity

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1,
    "op2_harmonic_packing": packing.op2,
    "op3_personal_data": pii.op3,
    "op4_repeated_strings": repeats.op4,
    "op5_toxicity": toxicity.op5,
    "op6_decontamination": decontamination.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_simhash": simhash.op8,
    "op9_license_notices": licenses.op9,
    "op10_chunk_store": chunk_store.op10,
    "op11_sentence_pieces": pieces.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_centroid_clusters": centroids.op13,
}

ORACLE_SQL = {
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op13_centroid_clusters": centroids.OP13_SQL,
}
