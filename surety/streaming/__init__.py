"""Streaming variants of the count-based metrics (an extension)."""
