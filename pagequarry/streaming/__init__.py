"""Structured Streaming variants: incremental extraction and a frontier with state per host."""
