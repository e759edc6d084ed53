"""Schemas, prompts, canonical views and the query catalogue."""
