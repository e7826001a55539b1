"""Pipelines and workflows: specification, run time, lineage, templates, service functions."""
