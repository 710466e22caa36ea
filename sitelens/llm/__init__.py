"""Operators for preparing training text: deduplication, filters, tokens, languages, mixtures.

Nothing else in the library imports this subpackage.
"""
