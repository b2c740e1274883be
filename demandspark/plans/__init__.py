"""Composed plans: the study pipeline, and the queries over the shared test tables."""
