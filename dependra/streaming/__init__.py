"""Structured Streaming: ingest of treebank files and running counts."""
