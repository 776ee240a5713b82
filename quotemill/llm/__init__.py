"""Operators for building training corpora: deduplication, filtering, extraction, mixing and formatting.

Nothing outside this subpackage imports it.  Every module offers one operator with a general interface; the
``op*`` queries that run them on the given tables are in :mod:`quotemill.llm.queries`.
"""
