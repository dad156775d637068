"""Operators of a training-data pipeline over document, page and label tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
