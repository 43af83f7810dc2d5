"""Structured Streaming forms of ingest, labelling, checks and alerting."""
