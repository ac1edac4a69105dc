"""Operators for preparing training text: deduplication, filters, packing, extraction, search, tokens, scores.

Nothing else in the package imports this subpackage.
"""
