"""Operators of a training-data pipeline over ``documents``, ``labels`` and ``embeddings``.

One module per operator, ``queries.py`` with the registered queries. Nothing outside this package
imports it; ``__spark_entry__.py`` adds its queries when the package is there.
"""
