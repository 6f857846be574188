"""Operators that prepare text for model training.

Nothing outside this folder imports it, except `__spark_entry__.py`
(guarded) and `corpus_pipeline.py`.
"""
