"""Operators for preparing large text corpora: deduplication, mixing, packing, scoring and search."""
