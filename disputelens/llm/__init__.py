"""Operators of a training-data pipeline over ``documents``, ``labels`` and ``embeddings``.

Each module holds one operator with its own interface; ``queries`` holds the
thin registered queries and their SQL. Nothing outside this folder imports it
but ``corpus_pipeline.py`` and the guarded import in ``__spark_entry__.py``.
"""
