"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> (module, function).
QUERIES = {
    "op3_language_model": "op3_language_model",
    "op7_suffix": "op7_suffix",
    "op4_jaccard": "op4_jaccard",
    "op1_quality": "op1_quality",
    "op2_packing": "op2_packing",
    "op5_language_id": "op5_language",
    "op6_toxicity": "op6_toxicity",
    "op8_piece_sampling": "op8_sampling",
    "op9_fingerprint": "op9_fingerprint",
    "op10_topk": "op10_topk",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in QUERIES.items():
        if sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None):
            out[name] = sql
    return out
