"""Readers of pages, caches and parameters."""
