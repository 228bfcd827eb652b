"""Incremental forms of the batch queries."""
