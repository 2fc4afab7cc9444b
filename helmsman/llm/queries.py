"""Imports every operator module, which registers its query."""

from __future__ import annotations

from . import conversation_repair, decontaminate, extendible, language_id, lm_score, mixing, neardup, patricia, prefix_trie, quality, secret_scan, toxicity, warc  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
