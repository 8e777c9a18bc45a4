"""Operators for preparing large text corpora: deduplication, filtering, counting, packing and formatting."""
