"""Operators for preparing training corpora.

Nothing outside this package (and ``corpus_pipeline.py`` at the top of the
repository) imports it.
"""
