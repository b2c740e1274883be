"""Incremental versions of the batch operators (Structured Streaming)."""
