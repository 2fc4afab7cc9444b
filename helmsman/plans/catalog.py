"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

from . import q_analytics, q_decision, q_index, q_kb, q_models, q_retrieval, q_streaming, q_text  # noqa: F401
from .registry import ORACLE, QUERIES


def flagship(spark, sf_dir):
    return QUERIES["g5_answer_batch"](spark, sf_dir)


__all__ = ["QUERIES", "ORACLE", "flagship"]
