"""Incremental loading and change data."""
