"""Operators for training corpora: filtering, deduplication, mixing, packing and formatting of texts."""
