"""Corpus scans, fact extraction, configuration and sinks."""
