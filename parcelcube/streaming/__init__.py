"""Structured Streaming forms of the time-bucket aggregations."""
