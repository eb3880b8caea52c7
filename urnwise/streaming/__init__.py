"""Incremental ingestion and the mining loop on Structured Streaming."""
