"""Operators for building language-model training data, each a set of Spark jobs.

Nothing outside this folder imports it, apart from the guarded import in ``__spark_entry__.py``
and ``corpus_pipeline.py``.
"""
