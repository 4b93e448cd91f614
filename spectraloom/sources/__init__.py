"""Bulk ingest and result tables."""
