"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import conversations, embedding, exact_dedup, language_rnn, license_scan, mixing, near_dedup, packing, periodic, pii, planes, secrets_scan, toxicity

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_packing": packing.op2_packing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_embedding": embedding.op6_embedding,
    "op7_planes": planes.op7_planes,
    "op8_secret_scan": secrets_scan.op8_secret_scan,
    "op9_pii": pii.op9_pii,
    "op10_minhash": near_dedup.op10_minhash,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_language_id": language_rnn.op13_language_id,
}

SQL = {"op3_exact_dedup": exact_dedup.SQL, "op11_conversation_repair": conversations.SQL}
