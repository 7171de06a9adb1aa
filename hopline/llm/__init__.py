"""Operators of a training-data pipeline: cleaning, matching, mixing and encoding of documents.

Nothing else in ``hopline`` imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` registers one query per
operator and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
