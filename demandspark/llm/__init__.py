"""Operators for large text corpora: similarity joins, deduplication, token output, filtering and extraction."""
