"""Analyses: counting, association, collexemes, larger structures, graph operators."""
