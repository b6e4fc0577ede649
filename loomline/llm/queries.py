"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from loomline.llm import decontam, neardup, packing, pii, quality, secrets, tokenstore, toxicity, urls, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_url_filter": urls.op2_url_filter,
    "op3_packing": packing.op3_packing,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_token_shards": tokenstore.op8_token_shards,
    "op9_warc": warc.op9_warc,
    "op10_secrets": secrets.op10_secrets,
}
ORACLES = {"op1_quality": quality.OP1_SQL, "op4_near_duplicates": neardup.OP4_SQL, "op7_decontamination": decontam.OP7_SQL, "op9_warc": warc.OP9_SQL}
