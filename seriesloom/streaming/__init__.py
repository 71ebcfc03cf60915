"""Continuous ingest through Structured Streaming."""
