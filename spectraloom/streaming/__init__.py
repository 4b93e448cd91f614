"""Incremental arrival on Structured Streaming."""
