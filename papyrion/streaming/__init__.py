"""Structured Streaming forms of the index events."""
