"""Structured Streaming forms of ingestion and answering."""
