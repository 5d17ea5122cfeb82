"""Operators of a training-data pipeline: dedup, scoring, mixing, formatting and output.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
