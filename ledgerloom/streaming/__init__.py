"""Incremental ingestion and streaming jobs."""
