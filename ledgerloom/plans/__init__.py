"""Composed queries, marts and models."""
