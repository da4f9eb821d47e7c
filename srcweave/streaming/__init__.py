"""Incremental scans and windowed counts with Structured Streaming."""
