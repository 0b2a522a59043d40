"""Composed plans, marts and the query registry."""
