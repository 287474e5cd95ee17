"""Operators for training-data pipelines: scoring, deduplication, mixing, tokenising, searching.

Nothing outside this package imports it; its queries are in ``patchlens.llm.queries``.
"""
