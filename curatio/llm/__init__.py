"""Operators for preparing language-model training data.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
