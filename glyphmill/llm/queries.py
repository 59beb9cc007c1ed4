"""The registered queries of this subpackage: one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, licences, mixing, packing, pii, quality, scoring, secrets, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.query,
    "op2_toxicity": toxicity.query,
    "op3_topk": topk.query,
    "op4_mixing": mixing.query,
    "op5_secrets": secrets.query,
    "op6_jaccard": jaccard.query,
    "op7_quality": quality.query,
    "op8_scoring": scoring.query,
    "op9_licences": licences.query,
    "op10_pii": pii.query,
}
ORACLE_SQL: dict[str, str] = {"op3_topk": topk.ORACLE_SQL, "op5_secrets": secrets.ORACLE_SQL, "op6_jaccard": jaccard.ORACLE_SQL, "op7_quality": quality.ORACLE_SQL}
