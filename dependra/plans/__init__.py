"""Patterns and their compilation into joins."""
