"""Operators for large text corpora: deduplication, packing, extraction, screening and encoding.

Nothing else in :mod:`cellweave` imports this subpackage.
"""
