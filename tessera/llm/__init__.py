"""Operators for preparing training text: deduplication, extraction, filters, packing.

Nothing else in the library imports this subpackage; ``queries.LLM_QUERIES``
lists its registered queries.
"""
