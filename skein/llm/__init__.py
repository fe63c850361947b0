"""Operators for preparing language-model training data (see README).

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports
it.  Each operator is one module; ``queries`` registers one query per operator.
"""
