"""Operators for preparing large text corpora: one module per operator.

Nothing else in the library imports this subpackage.  ``catalog`` registers
one query per operator, plus the pipeline of ``corpus_pipeline.py``.
"""
