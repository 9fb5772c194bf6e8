"""Operators for large-scale training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cotraining import op6_cotraining
from .fingerprints import op3_fingerprints
from .neardup import op4_minhash_dedup
from .packing import op8_best_fit
from .passages import op1_passage_chains
from .pieces import op2_sentencepiece
from .rules import op10_quality_rules
from .secrets import op7_markov_secrets
from .sharding import op9_slot_shards
from .urls import OP5_SQL, op5_url_rules

_OPERATORS = (
    op1_passage_chains, op2_sentencepiece, op3_fingerprints, op4_minhash_dedup, op5_url_rules,
    op6_cotraining, op7_markov_secrets, op8_best_fit, op9_slot_shards, op10_quality_rules,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; tests/llm holds the others against brute force."""
    return {"op5_url_rules": OP5_SQL}
