"""Operators for preparing training corpora (one module per operator).

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
