"""Operators for preparing training text: deduplication, filters, extraction, mixing and tokenizing.

Nothing outside this subpackage imports it. Every operator is a function from DataFrame to DataFrame; the registered
queries are in ``queries.py``.
"""
