"""Structured Streaming forms of ingestion and the work gate."""
