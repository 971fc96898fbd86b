"""Readers, schemas, sinks and the mapping of the given tables."""
