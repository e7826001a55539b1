"""Expressions in text, translated to columns."""
