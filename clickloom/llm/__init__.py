"""Operators for preparing training data: tokenising, filtering, deduplicating, fingerprinting and packing documents.

Nothing else in the package imports this subpackage; ``queries`` registers one query per operator.
"""
