"""The thirteen operators' queries by name, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fissure.llm import decontam, langid, licenses, negatives, packing, pii, repair, shards, sketch, tokens, urls, vectors, warc
from fissure.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": tokens.op1_token_output,
    "op2_language_id": langid.op2_language_id,
    "op3_url_filter": urls.op3_url_filter,
    "op4_pii": pii.op4_pii,
    "op5_packing": packing.op5_packing,
    "op6_embedding_dedup": vectors.op6_embedding_dedup,
    "op7_licenses": licenses.op7_licenses,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_sharding": shards.op9_sharding,
    "op10_minhash": sketch.op10_minhash,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_warc": warc.op13_warc,
}
