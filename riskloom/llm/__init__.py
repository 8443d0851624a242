"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage, and it can be deleted
with ``tests/llm`` and ``corpus_pipeline.py`` without touching the rest.
"""
