"""Operators of a training-data pipeline over the ``documents`` table.

Nothing outside this folder imports it, but for ``corpus_pipeline.py`` and the guarded
registration in ``__spark_entry__.py``.
"""
