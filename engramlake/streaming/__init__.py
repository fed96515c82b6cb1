"""Structured Streaming jobs for capture ingestion and graph refresh."""
