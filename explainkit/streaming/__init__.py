"""Structured Streaming: ingestion with extraction, and running counts."""
