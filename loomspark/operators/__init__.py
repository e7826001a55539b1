"""Relational operators and data-quality rules."""
