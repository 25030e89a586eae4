"""Corpora: readers, the canonical tables, writers."""
