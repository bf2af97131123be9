"""Structured Streaming forms of the incremental refresh."""
