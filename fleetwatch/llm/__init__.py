"""Operators for preparing text corpora: extraction, deduplication, scoring, tokens, archives, packing."""
