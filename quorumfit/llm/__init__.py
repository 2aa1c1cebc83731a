"""Operators of a training-data pipeline: filters, deduplication, mixing, encoding.

Nothing else in the library imports this subpackage.
"""
