"""Scalar functions: association measures and tag mappings, as column expressions."""
