"""Readers, sinks and injected providers."""
